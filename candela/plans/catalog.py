"""Imports every query module so that the registry is filled."""

from candela.plans import indicator_queries  # noqa: F401
from candela.plans.registry import ORACLES, QUERIES  # noqa: F401
from candela.plans import regime_queries  # noqa: F401, E402
from candela.plans import signal_queries  # noqa: F401, E402
from candela.plans import ledger_queries  # noqa: F401, E402
from candela.plans import metric_queries  # noqa: F401, E402
from candela.plans import walkforward_queries  # noqa: F401, E402
from candela.plans import monitor_queries  # noqa: F401, E402
from candela.plans import table_queries  # noqa: F401, E402
from candela.plans import source_queries  # noqa: F401, E402
from candela.plans import model_queries  # noqa: F401, E402
