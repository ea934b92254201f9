"""Survey column roles, label maps and the explicit input schema.

The lists and maps below are FIXED VALUES: column names, display labels and the brand
set must equal the survey layout the dashboard analytics are defined on, so they are
stated here plainly, in their natural order.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---- fixed values -------------------------------------------------------------------
SEGMENT_LABELS: dict[str, str] = {
    "Elite_Enthusiast": "Elite Enthusiast",
    "Family_WorkMom": "Family / WorkMom",
    "Tech_Purist": "Tech Purist",
    "Practical_Upgrader": "Practical Upgrader",
}
MODULE_COLS: list[str] = [
    "Q6_Module_MagSafe", "Q6_Module_BeverageLock", "Q6_Module_BagHook",
    "Q6_Module_Telemetry", "Q6_Module_Tray",
]
MODULE_NAMES: list[str] = [
    "MagSafe Mount", "Beverage Lock", "Bag Hook", "Telemetry Rail", "Utility Tray",
]
FRICTION_COLS: list[str] = [
    "Q4_Friction_Wobble", "Q4_Friction_Aesthetic", "Q4_Friction_Block",
    "Q4_Friction_Degradation",
]
FRICTION_NAMES: list[str] = [
    "Wobble / Shake", "Aesthetic Clash", "Vent Blocking", "Surface Damage",
]
PRICE_COLS: list[str] = [
    "Q8_Price_Too_Cheap", "Q9_Price_Bargain", "Q10_Price_Expensive",
    "Q11_Price_Too_Expensive",
]
SCORE_COL = "Q5_Rattle_Severity_Scale"
TARGET_COL = "Q12_Reserve_Slot_Intent"
KMEANS_FEATURES: list[str] = [SCORE_COL] + PRICE_COLS + MODULE_COLS + FRICTION_COLS
MODEL_FEATURES: list[str] = [SCORE_COL] + FRICTION_COLS + MODULE_COLS + PRICE_COLS
MODEL_FEATURE_LABELS: list[str] = [
    "Rattle Severity",
    "Friction: Wobble", "Friction: Aesthetic", "Friction: Vent Block", "Friction: Damage",
    "Module: MagSafe", "Module: Bev. Lock", "Module: Bag Hook", "Module: Telemetry",
    "Module: Tray",
    "Price: Too Cheap", "Price: Bargain", "Price: Expensive", "Price: Too Expensive",
]
RULE_FEATURE_LABELS: dict[str, str] = {
    "Q5_Rattle_Severity_Scale": "Rattle Severity (1–5)",
    "Q4_Friction_Wobble": "Friction: Wobble",
    "Q4_Friction_Aesthetic": "Friction: Aesthetic",
    "Q4_Friction_Block": "Friction: Vent Block",
    "Q4_Friction_Degradation": "Friction: Surface Damage",
    "Q6_Module_MagSafe": "Wants MagSafe",
    "Q6_Module_BeverageLock": "Wants Beverage Lock",
    "Q6_Module_BagHook": "Wants Bag Hook",
    "Q6_Module_Telemetry": "Wants Telemetry Rail",
    "Q6_Module_Tray": "Wants Utility Tray",
    "Q8_Price_Too_Cheap": "Too Cheap Price ($)",
    "Q9_Price_Bargain": "Bargain Price ($)",
    "Q10_Price_Expensive": "Expensive Price ($)",
    "Q11_Price_Too_Expensive": "Too Expensive Price ($)",
}
SCORE_LABELS: dict[int, str] = {
    1: "1 — Not bothered", 2: "2 — Slight", 3: "3 — Moderate",
    4: "4 — Very frustrated", 5: "5 — Intolerable",
}
BUDGET_BRANDS: list[str] = [
    "Toyota", "Honda", "Hyundai", "Kia", "Maruti Suzuki", "Volkswagen", "Nissan",
]
BRAND_CLASS_LABELS = ("Budget / Mass Market", "Premium / Luxury")
LIFT_BANDS = ((1.3, "strong"), (1.1, "moderate"))  # lift >= 1.3 / >= 1.1 / else "weak"
LIFT_BAND_ELSE = "weak"
# Van Westendorp grid: 600 points from 5 to 700 inclusive.
GRID_LO, GRID_HI, GRID_N = 5.0, 700.0, 600
# Default thresholds of the analyses.
MIN_SUPPORT = 0.10
MIN_SUPPORT_SEGMENT = 0.08
MIN_LIFT = 1.0
DEFAULT_MIN_CONFIDENCE = 0.45
OVERFIT_GAP_POINTS = 5.0
CLASS_DIFF_POINTS = 20.0
KMEANS_K = 4
SEED = 42
# ---- end of fixed values ------------------------------------------------------------


@dataclass(frozen=True)
class SurveySpec:
    """Role → column mapping; every operator takes one so layouts can vary."""
    id_col: str = "respondent_id"
    segment_col: str = "Segment"
    year_col: str = "Q1_Vehicle_Year"
    brand_col: str = "Q2_Vehicle_Brand"
    style_col: str = "Q3_Aesthetic_Style"
    concern_col: str = "Q7_Primary_Concern"
    score_col: str = SCORE_COL
    target_col: str = TARGET_COL
    friction_cols: tuple = tuple(FRICTION_COLS)
    friction_names: tuple = tuple(FRICTION_NAMES)
    module_cols: tuple = tuple(MODULE_COLS)
    module_names: tuple = tuple(MODULE_NAMES)
    price_cols: tuple = tuple(PRICE_COLS)
    segment_labels: dict = field(default_factory=lambda: dict(SEGMENT_LABELS))

    @property
    def too_cheap(self) -> str:
        return self.price_cols[0]

    @property
    def bargain(self) -> str:
        return self.price_cols[1]

    @property
    def expensive(self) -> str:
        return self.price_cols[2]

    @property
    def too_expensive(self) -> str:
        return self.price_cols[3]

    @property
    def kmeans_features(self) -> list:
        return [self.score_col, *self.price_cols, *self.module_cols, *self.friction_cols]

    @property
    def model_features(self) -> list:
        return [self.score_col, *self.friction_cols, *self.module_cols, *self.price_cols]


DEFAULT_SPEC = SurveySpec()


def survey_schema() -> T.StructType:
    """Explicit schema of the survey table (extra columns are tolerated on read)."""
    f = T.StructField
    fields = [
        f("respondent_id", T.LongType(), False),
        f("Segment", T.StringType(), True),
        f("Q1_Vehicle_Year", T.IntegerType(), True),
        f("Q2_Vehicle_Brand", T.StringType(), True),
        f("Q3_Aesthetic_Style", T.StringType(), True),
    ]
    fields += [f(c, T.IntegerType(), True) for c in FRICTION_COLS]
    fields += [f(SCORE_COL, T.IntegerType(), True)]
    fields += [f(c, T.IntegerType(), True) for c in MODULE_COLS]
    fields += [f("Q7_Primary_Concern", T.StringType(), True)]
    fields += [f(c, T.DoubleType(), True) for c in PRICE_COLS]
    fields += [f(TARGET_COL, T.IntegerType(), True)]
    return T.StructType(fields)


SURVEY_COLUMNS: list[str] = [x.name for x in survey_schema().fields]
