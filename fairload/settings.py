"""Parameters of the two domains. Fixed values that results depend on are stated here."""

from __future__ import annotations

from dataclasses import dataclass, field

# Column order of the model inputs and the label shown for each input.
TX_FEATURES = (
    "age_years",
    "capacity_kva",
    "loading_mean",
    "loading_max",
    "overload_minutes",
    "sag_count",
    "thermal_stress",
)
TX_LABELS = {
    "age_years": "AGED-ASSET",
    "capacity_kva": "SMALL-DT",
    "loading_mean": "SUSTAINED-LOAD",
    "loading_max": "PEAK-OVERLOAD",
    "overload_minutes": "OVERLOAD-TIME",
    "sag_count": "VOLTAGE-SAGS",
    "thermal_stress": "THERMAL-STRESS",
}
CROP_FEATURES = ("peak_ndvi", "integ_ndvi", "water_stress", "gdd_frac", "pest_index")
CROP_LABELS = {
    "peak_ndvi": "LOW-CANOPY",
    "integ_ndvi": "LOW-BIOMASS",
    "water_stress": "DRY-SPELL-REPRO",
    "gdd_frac": "HEAT-STRESS",
    "pest_index": "PEST-PRESSURE",
}

# Weights of the two priority indices and of shed pain.
FCI_WEIGHTS = {"forecast_stress": 0.35, "tx_risk": 0.30, "utilization": 0.20, "volatility": 0.15}
VAPI_WEIGHTS = {"loss_risk": 0.35, "yield_shortfall": 0.30, "ndvi_decline": 0.20, "exposure": 0.15}
CLASS_PAIN = {"residential": 0.35, "commercial": 0.50, "industrial": 0.65}
PROTECTED_PAIN = 9.99

# What counts for a feeder that a source says nothing about, and from where on a reason code is given.
FEEDER_ABSENT = {"tx_risk_max": 0, "tx_risk_mean": 0, "tx_high_risk": 0, "shed_hours_30d": 0, "complaints_30d": 0}
FEEDER_LIMITS = {
    "forecast_stress": 0.95,
    "tx_high_risk": 1,
    "utilization_now": 0.9,
    "c_volatility": 0.7,
    "shed_hours_30d": 8,
    "sag_rate": 0.5,
}

# Crop traits (peak NDVI, degree-days to maturity, water sensitivity) and how far
# irrigation relieves a dry spell.
CROP_TRAITS = {
    "rice": (0.86, 1650.0, 1.00),
    "cotton": (0.78, 2100.0, 0.70),
    "maize": (0.82, 1500.0, 0.85),
    "soybean": (0.80, 1400.0, 0.80),
}
IRRIGATION_RELIEF = {"canal": 0.55, "borewell": 0.75}


@dataclass(frozen=True)
class GridSettings:
    grain_s: int = 900  # seconds between grid points
    reading_s: int = 900  # seconds of energy that one reading covers
    v_sag: float = 207.0
    unit_error_kwh: float = 100.0
    usable_kw_per_kva: float = 0.9
    horizon: int = 16  # intervals ahead
    rolling_rows: int = 8
    lags: tuple[int, ...] = (1, 2, 3, 4)

    @property
    def slots_per_day(self) -> int:
        return 86400 // self.grain_s

    @property
    def kw_per_kwh(self) -> float:
        return 3600.0 / self.reading_s

    @property
    def steps_ahead(self) -> int:
        """A same-slot-yesterday forecast can look at most one day ahead."""
        return min(self.horizon, self.slots_per_day)


@dataclass(frozen=True)
class AgroSettings:
    unit_error_ndvi: float = 1.5
    ndvi_floor: float = 0.05
    ndvi_ceiling: float = 1.0
    gdd_base: float = 10.0
    maturity_gdd: float = 1650.0
    live_pest_index: float = 0.15


@dataclass(frozen=True)
class LogitCard:
    """Closed form of a fitted logistic model on standardised inputs."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weight: tuple[float, ...]
    bias: float
    labels: dict[str, str] = field(default_factory=dict, hash=False)


# Stand-in coefficients, so that scores can be checked against SQL without fitting first.
TX_RISK_CARD = LogitCard(
    features=TX_FEATURES,
    mean=(18.0, 170.0, 0.6, 1.0, 30.0, 1.0, 0.3),
    scale=(10.0, 85.0, 0.4, 0.6, 60.0, 2.0, 1.0),
    weight=(0.6, -0.3, 0.8, 1.0, 0.7, 0.4, 0.5),
    bias=-0.6,
    labels=TX_LABELS,
)
CROP_LOSS_CARD = LogitCard(
    features=CROP_FEATURES,
    mean=(0.75, 14.0, 0.35, 0.9, 0.17),
    scale=(0.12, 6.0, 0.25, 0.2, 0.12),
    weight=(-0.7, -0.5, 1.4, -0.3, 0.6),
    bias=-0.4,
    labels=CROP_LABELS,
)
# Intercept, then one slope for each of CROP_FEATURES.
YIELD_LINE = (1.1, 1.6, 0.03, -1.2, 0.8, -1.0)
YIELD_FLOOR = 0.2
