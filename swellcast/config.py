"""Fixed values.

The values below must equal the reference's for identical results: sentinel
codes, column roles, time constants and numeric constants of the
statistical tests. They are stated plainly, in their natural order.
"""

# --- fixed values: missing-value sentinels per column -----------------------
SENTINELS = {
    "WSPD": [99.0], "GST": [99.0], "DPD": [99.0], "WVHT": [99.0], "APD": [99.0],
    "PRES": [9999.0],
    "ATMP": [999.0], "WTMP": [999.0], "DEWP": [999.0],
}

# --- fixed values: column roles ----------------------------------------------
ANGLE_COLUMNS = ["WDIR", "MWD"]
DROP_COLUMNS = ["TIDE", "VIS", "DPD"]
TARGETS = ["WVHT", "APD"]
CLEAN_COLUMNS = ["WSPD", "GST", "WVHT", "APD", "PRES", "ATMP", "WTMP", "DEWP",
                 "WDIR_sin", "WDIR_cos", "MWD_sin", "MWD_cos"]
EXOGENOUS = [c for c in CLEAN_COLUMNS if c not in TARGETS]

# --- fixed values: time constants (hours) ------------------------------------
HORIZON = 72
WINDOW = 504

# --- fixed values: feature recipes --------------------------------------------
TARGET_LAGS = [1, 2, 3, 4, 24, 48, 72]
LAGGED_MEANS = [(1, 24), (24, 48)]
DIRECT_LAGS = [1, 2, 3, 24, 48]

# --- fixed values: numeric constants -----------------------------------------
EPS = 2.220446049250313e-16            # float64 machine epsilon
Z_975 = 1.959963984540054               # standard normal 0.975 quantile
HP_LAMBDA = 1600.0
CF_LOW, CF_HIGH = 6, 32
UNIQUE_THRESHOLD = 20

# Chunk length (rows of the hourly grid) used to spread one long series over
# several tasks. One year of hours; tests shrink it to prove chunked == plain.
CHUNK = 8760
