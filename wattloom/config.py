"""Default thresholds. Every operator takes them as keyword parameters."""

from __future__ import annotations

# Defaults that results must agree with.
LOCAL_TZ = "Asia/Kolkata"
STALE_AFTER_S = 900
CLOCK_SKEW_S = 300
SPIKE_MULTIPLE = 1.5
ENERGY_INTERVAL_S = 3600
MIN_COVERAGE_PCT = 80.0
MIN_BASELINE_INTERVALS = 24
BASELINE_HOLDOUT_FRACTION = 0.2
EXPECTED_EPSILON_KWH = 0.5
DEVIATION_WARN_PCT = 15.0
DEVIATION_CRIT_PCT = 30.0
DEVIATION_CONSECUTIVE_N = 2
IDLE_SHARE_THRESHOLD = 0.5
IDLE_CONSECUTIVE_N = 4
RATED_POWER_MULTIPLE = 1.1
PF_MIN_THRESHOLD = 0.6
MAD_THRESHOLD = 4.0
MAD_WINDOW = 24
G14_CV_MAX_PCT = 30.0
G14_NMBE_MAX_PCT = 10.0
HEALTH_MODEL_ID = "statistical-v1"
HEALTH_MIN_REF_INTERVALS = 24
HEALTH_MIN_BUCKET_ROWS = 3
HEALTH_WARN_Z = 4.0
HEALTH_CRIT_Z = 6.0
HEALTH_MAD_FLOOR_FRAC = 0.10
HEALTH_MAD_EPSILON = 1e-6
OPT_SLOT_MIN = 15
OPT_HORIZON_H = 24
OPT_W_ENERGY_KWH = 1.0
OPT_W_PEAK_KW = 10.0
OPT_W_COST_INR = 1.0
OPT_HEAT_CHARGE_KG = 375.0
OPT_MELT_RATE_KG_H = 500.0
OPT_HEATING_H = 0.333
OPT_HOLD_MIN_H = 0.25
OPT_HOLD_MAX_H = 0.75
OPT_COLD_THRESHOLD_H = 2.0
OPT_REHEAT_EXTRA_H = 0.25
PROCESS_MIN_HOLD_H = 0.25
COMPARABLE_PROD_TOL = 0.01
VERIFY_CONFIDENCE = 0.90
VERIFY_MIN_BASELINE_POINTS = 72
VERIFY_MIN_POST_POINTS = 24
VERIFY_MIN_COMPLETE_FRAC = 0.90
VERIFY_PROD_TOL_PCT = 15.0
VERIFY_MAX_EXTRAPOLATED_FRAC = 0.05
VERIFY_BASELINE_DAYS = 7

NON_PRODUCTION_TYPES = ("pump", "compressor")
STATES = ("heating", "melting", "holding", "idle", "running", "stopped", "shutdown", "auxiliary")
HEAT_STATES = ("heating", "melting", "holding", "idle")
NON_PRODUCTIVE_STATES = ("idle", "holding", "stopped", "shutdown", "auxiliary")
SOURCES = ("MEASURED", "SIMULATED", "DERIVED", "EXTERNAL_REFERENCE", "PROJECTED", "ASSUMPTION")
TELEMETRY_FIELDS = (
    "voltage_v", "current_a", "power_kw", "reactive_power_kvar", "power_factor",
    "energy_kwh", "vibration_mm_s", "temperature_c", "rpm", "runtime_h",
)
PRODUCTION_FIELDS = ("qty_total_kg", "qty_good_kg", "qty_rejected_kg", "operating_time_h")
HEALTH_SIGNALS = ("vibration_mm_s", "temperature_c", "current_a")
HEALTH_MODELS = ("statistical-v1",)
SUPERHEAT_KWH_PER_T_PER_C = 0.33
HEAT_TARGET_C = 1550.0
STATE_POWER_FRACTION = {"heating": 0.85, "melting": 0.95, "holding": 0.45, "idle": 0.08}
