"""Column builders: calendar keys, scalar features and error metrics."""

from tidemill.functions.calendar import *  # noqa: F401,F403
from tidemill.functions.metrics import *  # noqa: F401,F403
from tidemill.functions.scalars import *  # noqa: F401,F403
