"""Reference instants used where an operator takes ``as_of``."""

from datetime import datetime

AS_OF = datetime(2000, 1, 1)
AS_OF_SQL = "TIMESTAMP '2000-01-01 00:00:00'"
EVENTS_AS_OF = datetime(2024, 1, 20, 12)
EVENTS_AS_OF_SQL = "TIMESTAMP '2024-01-20 12:00:00'"
