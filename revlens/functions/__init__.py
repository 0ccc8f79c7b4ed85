"""Scalar Column expressions.  Everything here is a built-in Spark expression
(JVM side, whole-stage codegen) - no Python runs per row."""

from revlens.functions.text import *  # noqa: F401,F403
from revlens.functions.ratings import *  # noqa: F401,F403
from revlens.functions.dates import *  # noqa: F401,F403
from revlens.functions.size import *  # noqa: F401,F403
from revlens.functions.sites import *  # noqa: F401,F403
