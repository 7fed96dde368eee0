"""Column builders; every one stays a built-in JVM expression."""

from wattlens.functions.formulas import *  # noqa: F401,F403
from wattlens.functions.keys import *  # noqa: F401,F403
from wattlens.functions.sequences import *  # noqa: F401,F403
