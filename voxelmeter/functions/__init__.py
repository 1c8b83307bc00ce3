from voxelmeter.functions.columns import *  # noqa: F401,F403
from voxelmeter.functions.ranks import *  # noqa: F401,F403
