"""Constants that results depend on, stated as plain text."""

# --- promotion calendar: family -> (start day of year, length in days) ---------------------------
PROMO_EVERY_YEAR = {
    "promo_spring": (77, 30),
    "promo_midyear": (174, 29),
    "promo_fall": (242, 32),
    "promo_yearend": (322, 45),
}
PROMO_ODD_YEARS = {
    "promo_rural": (30, 30),
    "promo_urban_blowout": (211, 34),
}
PROMO_TITLES = {
    "promo_spring": "Spring Sale",
    "promo_midyear": "Mid-Year Sale",
    "promo_fall": "Fall Launch",
    "promo_yearend": "Year-End Sale",
    "promo_rural": "Rural Special",
    "promo_urban_blowout": "Urban Blowout",
}

# --- lunar new year as listed, 1995-2002 (test tables) and 2012-2024: what the computed calendar must give ----
LUNAR_NEW_YEAR = (
    "1995-01-31", "1996-02-19", "1997-02-07", "1998-01-28",
    "1999-02-16", "2000-02-05", "2001-01-24", "2002-02-12",
    "2012-01-23", "2013-02-10", "2014-01-31", "2015-02-19",
    "2016-02-08", "2017-01-28", "2018-02-16", "2019-02-05",
    "2020-01-25", "2021-02-12", "2022-02-01", "2023-01-22", "2024-02-10",
)

# --- the nine event names, in column order ------------------------------------------------------
EVENTS = (
    "end_of_month", "start_of_month", "tet",
    "promo_spring", "promo_midyear", "promo_fall", "promo_yearend",
    "promo_rural", "promo_urban_blowout",
)

# --- residual learner features -----------------------------------------------------------------
RESIDUAL_FEATURES = ("resid_lag365", "resid_lag364", "resid_lag366", "resid_roll28_lag365")
TREND_FEATURES = ("structural_trend",)
EXOG_FEATURES = ("fill_rate_lag365", "days_of_supply_lag365", "overstock_pct_lag365", "sessions_lag365")
EXOG_ANCHOR_FEATURES = ("fill_rate_lag730", "sessions_lag730")
CALENDAR_FEATURES = ("month", "dayofweek", "is_month_end", "weekofyear", "quarter", "dayofyear")
CALENDAR_EXTRA_FEATURES = ("days_to_month_end", "week_of_month")
REGIME_FEATURES = ("is_even_year", "urban_expected", "days_to_promo")
BASE_FEATURES = RESIDUAL_FEATURES + TREND_FEATURES + CALENDAR_FEATURES
ALL_FEATURES = (
    RESIDUAL_FEATURES + ("resid_lag730",) + TREND_FEATURES + EXOG_FEATURES + EXOG_ANCHOR_FEATURES
    + REGIME_FEATURES + CALENDAR_FEATURES + CALENDAR_EXTRA_FEATURES
)

# --- planning tables ----------------------------------------------------------------------------
BUDGET_SHARES = {"Q1": 43, "Q2": 37, "Q3": 5, "Q4": 14}
BAND_MULTIPLIER = 1.22
# lower bound of traffic change vs last year (%), zone, chance of a sales drop, action
WARNING_ZONES = (
    (-10.0, "green", "<15%", "monitor as usual"),
    (-20.0, "yellow", "~25%", "raise buffer by 5%, alert supply chain"),
    (None, "red", "~37%", "stop non-essential promotions, raise buffer by 10%, report to finance"),
)

# --- critical values of the two-variable residual unit-root test with constant (MacKinnon 2010) ---
COINTEGRATION_CRITICAL = {"1%": -3.89644, "5%": -3.33613, "10%": -3.04445}
# --- response surface of its p-value (MacKinnon 1994): polynomials in the statistic below and above the bend ---
COINTEGRATION_SURFACE = {"lowest": -18.86, "bend": -2.62, "highest": 0.92,
                         "low": (2.92, 1.5012, 0.039796), "high": (2.1945, 0.64695, -0.29198, -0.042377)}
