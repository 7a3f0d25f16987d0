"""Indoor positioning on Spark: which shop is a phone in, given its WiFi scan?"""

from aislefix.settings import Settings
from aislefix.session import build_session

__all__ = ["Settings", "build_session"]
