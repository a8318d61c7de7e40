"""Thresholds, word lists, lookups and texts that results depend on. No logic here."""

# --- market bands (USD) ---
TARGET_MC = (100_000, 500_000)
TARGET_MIN_LIQUIDITY = 10_000
RULE_MIN_LIQUIDITY = 50_000
RULE_MIN_VOLUME = 50_000
SOURCE_BANDS = {"latest": (10_000, 2_000_000), "top_volume": (50_000, 1_000_000)}
LAUNCH_BAND = (50_000, 1_000_000)
LAUNCH_MIN_HOLDERS = 50
LAUNCH_LIMIT = 20
CHAINS = ("solana", "ethereum", "base")
DISCOVERY = {"max_mc": 100_000_000, "min_volume": 1_000_000, "min_change": -50, "max_change": 200, "flag_gain": 50}

# --- age (days / hours) and momentum (percent) ---
AGE_DAYS = (4, 10)
DISCOVERY_MAX_AGE_HOURS = 72
AGED_BY_TURNOVER = 0.1
MOMENTUM = (-5, 200)

# --- candle patterns ---
EMA_LEN = 50
FETCH_CANDLES = 100
MIN_CANDLES = {"A": 52, "B": 60, "C": 80}
PATTERN_C_MIN_MC = 300_000
PATTERN_TEXT = {
    "A": "12h close reclaimed EMA50",
    "B": "4H close reclaimed EMA50 after dump",
    "C": "1H EMA50 hold after pump",
}
TIMEFRAME_SECONDS = {
    "1m": 60, "5m": 300, "15m": 900, "30m": 1800,
    "1H": 3600, "2H": 7200, "4H": 14400, "6H": 21600, "8H": 28800, "12H": 43200,
    "1D": 86400, "3D": 259200, "1W": 604800, "1M": 2592000,
}
ENGINE_COOLDOWN_HOURS = 72
MONITOR_COOLDOWN_HOURS = 6
HISTORY_KEEP = 100
TRADES_KEEP = 50

# --- wallets ---
WALLET_MIN_LIQUIDITY = 25_000
WALLET_MIN_VOLUME = 50_000
WALLET_MAX_TOP10 = 35
WALLET_CONFIRMATIONS = 2
COMMON_TOKENS = 5
INACTIVE_DAYS = 45
LOSER_DAYS = 30
CANDIDATE_CONFIDENCE = 0.7
CONVERGENCE_WALLETS = 3
DIVERGENCE_PCT = 5
FLOW_THRESHOLD = 500_000
LARGE_TRANSFER = 100
LARGE_TRANSFER_LIMIT = 50
MIN_TRANSACTION_USD = 10_000
WHALE_BALANCE = 10_000
WHALE_ACTIVITY_MIN = 500

# --- default rule settings, overlaid by a config table ---
DEFAULT_THRESHOLDS = {
    "min_transaction_usd": 10_000.0,
    "convergence_min_whales": 3.0,
    "divergence_threshold": 0.05,
    "exchange_flow_threshold": 500_000.0,
}

# --- bets ---
MIN_MARKET_VOLUME = 1_000_000
MIN_MARKET_LIQUIDITY = 500_000
PROBABILITY_RANGE = (0.20, 0.80)
LONGSHOT = 0.15
MIN_EDGE = 0.10
MIN_EDGE_EXTREME = 0.15
MAX_POSITION = 3.0
MIN_POSITION = 0.5
MAX_POSITION_EXTREME = 1.0
KELLY_SHARE = 0.25
MAX_DAILY_EXPOSURE = 15.0
STOP_LOSS = 0.20
COPY_CONFIDENCE = 0.80
COPY_MIN_SIZE = 100
HEDGE_TIERS = (("T1", 0.95), ("T2", 0.92), ("T3", 0.87))
HEDGE_MIN_COVERAGE = 0.90
WATCH_ADDED = "2026-01-01"  # day that a watchlist row without a date counts as added on
SCANNER_AGE_NOTE = "4-10 days (scanner verified)"
SCANNER_CHAIN = "solana"
SCANNER_SOURCE_NOTE = "Auto-added from scanner"
LONGSHOT_WARNING = "LOW_PROB_HIGH_EDGE - Review carefully (Fed pattern)"

# --- words ---
BULL_WORDS = ("bull", "bullish", "pump", "moon", " ATH", "breakout", "green", "up", "rise", "gain")
BEAR_WORDS = ("bear", "bearish", "dump", "crash", "dip", "red", "down", "fall", "loss", "liquidated")
TOPIC_WORDS = ("btc", "bitcoin", "crypto")
URGENT_WORDS = ("payment failed", "security alert", "suspicious", "unauthorized", "expired", "expiring", "overdue",
                "declined", "blocked")
HEADS_UP_WORDS = ("meeting", "appointment", "reminder", "subscription", "renewal", "invoice", "deadline", "scheduled")
CONFIDENCE_WORDS = (("high", 0.8), ("medium", 0.6), ("low", 0.4))

# --- agents ---
JOB_STATUS = ("pending", "assigned", "in_progress", "completed", "failed")
ACTIVE_JOB_STATUS = ("pending", "assigned", "in_progress")
AGENT_STATUS = ("idle", "working", "blocked", "error", "offline")
OPPORTUNITY_STATUS = ("pending", "approved", "rejected", "expired")
EXECUTION_STATUS = ("pending", "executed", "failed", "settled")
SIDES = ("YES", "NO")
JOB_PRIORITY = (1, 10)
CAPABILITIES = {
    "scanner": ("market_scan", "opportunity_detection", "research"),
    "trader": ("trade_execution", "position_management", "risk_management"),
    "researcher": ("deep_research", "sentiment_analysis", "probability_estimation"),
    "reporter": ("reporting", "monitoring", "alerting"),
    "coordinator": ("job_dispatch", "agent_management", "system_monitoring"),
}

# --- watchlist upkeep ---
WATCH_MAX_AGE_DAYS = 10
DISTRIBUTION_PCT = -50

# --- texts of the daily engine report (fixed outputs) ---
DAILY_A = {
    "history": "Has history (4+ days)",
    "steady": "Steady uptrend (10-100%)",
    "mild": "Mild uptrend (5-10%)",
    "positive": "Positive momentum",
    "riding": "🚀 GIGA pattern - Riding EMA50 higher (perfect trend)",
    "double_top": "⚠️ Double top breakdown pattern (丙午) - AVOID",
    "dead": "⚠️ Parabolic collapse (-90%+ from ATH) - DEAD TOKEN",
    "drawdown": "⚠️ Heavy drawdown (-70%+ from ATH) - avoid",
    "decline": "⚠️ Accelerating decline - distribution phase",
}
DAILY_B = {
    "strong": "Strong pump (+%.0f%%)",
    "good": "Good pump (+%.0f%%)",
    "tempered": "Not parabolic, has history",
    "high_volume": "High volume ($%.0fK)",
    "good_volume": "Good volume ($%.0fK)",
    "rejections": "WhiteWhale pattern (%d EMA50 rejections) - whale accumulation",
    "tests": "Multiple EMA50 tests (%d) - building support",
    "tested": "EMA50 tested (%d)",
}
DAILY_C = {
    "mc_300": "MC ≥$300K ($%.0fK)",
    "mc_200": "MC ≥$200K ($%.0fK)",
    "strong": "Strong pump (+%.0f%%)",
    "good": "Good pump (+%.0f%%)",
    "mild": "Mild pump (+%.0f%%)",
    "holding": "Holding gains (SELFCLAW pattern)",
    "support_5": "Strong EMA50 support (%d touches) - Trophy Tomato pattern",
    "support_3": "Good EMA50 support (%d touches)",
    "support_1": "EMA50 tested (%d touch)",
    "high_volume": "High volume ($%.0fK) - 114514 pattern",
    "good_volume": "Good volume ($%.0fK)",
    "some_volume": "Decent volume ($%.0fK)",
    "buying_strong": "Strong buy pressure (%.2fx) - whale accumulation",
    "buying": "Buy pressure (%.2fx)",
    "selling": "Sell pressure (%.2fx) - caution",
    "old_enough": "4+ days old (EMA50 established)",
    "fresh": "Fresh momentum (<10 days)",
    "mature": "Mature uptrend with strong support",
}
NO_DATA = "Insufficient data"

# --- line formats of scanner output and run logs ---
LOG_HEADER = r"^\d+\.\s+[🚀📈💎📉]\s+(.+)\s+\(\$([A-Z]+)\)"
LOG_CHANGE = r"24h:\s*([+-]?[\d.]+)%"
LOG_MARKET_CAP = r"MC:\s*\$?([\d,]+)"
LOG_TOKEN = r"/token/([A-Za-z0-9]+)"
LOG_LINK = "Solscan:"
LOG_BANNER = "=== Multi-Source"
LOG_TIME = r"^\[([^\]]+)\]"
LOG_METRICS = {
    "unique_tokens": r"Total unique tokens found: (\d+)",
    "too_fresh": r"Filtered out (\d+) tokens < \d+ days",
    "too_old": r"Filtered out (\d+) tokens > \d+ days",
    "in_window": r"Tokens in sweet spot \([^)]*\): (\d+)",
    "matches": r"Complete: (\d+) sweet spot matches",
    "others": r"Complete: \d+ sweet spot matches, (\d+) others",
}
