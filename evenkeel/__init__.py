"""evenkeel: source-versus-target reconciliation of tables on Spark."""

from evenkeel.config import AuditConfig, TableConfig, load_config
from evenkeel.session import session

__all__ = ["AuditConfig", "TableConfig", "load_config", "session"]
