"""Fixed values of the activity model, and the settings of a timeline."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values, as the data and the answers need them -----------------------------------------
CLASSES = ("Lying down", "Sitting", "Walking", "Running", "Bicycling", "Standing in place", "Standing and moving")
STATIC = ("Lying down", "Sitting", "Standing in place")
DYNAMIC = ("Walking", "Running", "Bicycling", "Standing and moving")
INTENTS = ("identification", "verification", "duration", "count", "comparison", "grounding", "open_world", "unsupported")
VERB_STEMS = (
    ("walk", "Walking"), ("stroll", "Walking"),
    ("run", "Running"), ("jog", "Running"), ("ran", "Running"),
    ("sit", "Sitting"), ("sat", "Sitting"), ("seated", "Sitting"),
    ("lie ", "Lying down"), ("lay ", "Lying down"), ("lying", "Lying down"),
    ("laid", "Lying down"), ("rest", "Lying down"),
    ("cycl", "Bicycling"), ("bike", "Bicycling"), ("biking", "Bicycling"),
    ("bicycl", "Bicycling"), ("pedal", "Bicycling"),
    ("stand", "Standing in place"), ("stood", "Standing in place"),
)
#: What a question asks for, in the order in which rules are tried: intent, how it may begin, what it may hold, what it must hold besides.
INTENT_RULES = (
    ("comparison", (), ("more", "longer", "spend"), " or "),
    ("count", ("how many", "how often"), ("times",), ""),
    ("duration", ("how long",), ("total time", "how much time"), ""),
    ("grounding", (), ("when", "begin", "start", "onset"), ""),
    ("verification", ("is ", "was ", "did ", "does "), (), ""),
    ("identification", (), ("what activity", "what is", "doing"), ""),
)
GERUND = {c: c.lower() for c in CLASSES}
MODALITY, CHANNELS, NA = "Accelerometer, Gyroscope", "All", "N/A"
SEGMENT, RATE, SECONDS = 128, 32.0, 4.0
GRAVITY = 9.80665
# -------------------------------------------------------------------------------------------------

SIX = ("acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z")


@dataclass(frozen=True)
class TimelineConfig:
    """Seconds, but for mode_k (segments) and p_stay (a probability)."""

    smoothing: str = "mode"
    mode_k: int = 5
    p_stay: float = 0.95
    max_gap_s: float = 120.0
    min_interval_s: float = 8.0
    min_episode_s: float = 60.0
    prolonged_s: float = 480.0

# --- fixed values: phrases that decide what a question asks for ------------------------------------
PROLONGED_WORDS = ("prolonged", "long time", "long period", "extended period", "long stretch", "for long", "lengthy", "long while")
WHEELED_WORDS = ("wheeled", "pedal", "cycl", "bicycl", "bike", "biking")
OPEN_PHRASES = ("wheeled", "pedal-based", "pedal based", "mostly at rest", "mostly active", "physically active")
# ---------------------------------------------------------------------------------------------------
