"""Column -> Column functions, all native Catalyst expressions."""

from semestra.functions.numeric import *  # noqa: F401,F403
from semestra.functions.schedule import *  # noqa: F401,F403
from semestra.functions.text import *  # noqa: F401,F403
