"""Fixed values of the domain; rates can be set in the environment."""

from __future__ import annotations

import os

RISK_FREE = float(os.environ.get("RISK_FREE_RATE", "0.015"))
DIVIDEND = float(os.environ.get("DIVIDEND_YIELD", "0.035"))
MULTIPLIER = 50
TRADING_DAYS = 252
CALENDAR_DAYS = 365
DTE_BAND = 7
DELTA_TOLERANCE = 0.05
SKEW_THRESHOLD = 0.01
Q_CAP = 0.15
COVERAGE_MINIMUM = 0.95
EULER = 0.5772156649015329
