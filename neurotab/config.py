"""Fixed values of the signal pipeline.

FIXED VALUES — these must equal the analysed pipeline's constants for the
results to agree; they are stated here plainly and in their natural order.
"""

SAMPLING_RATE = 128          # Hz after resampling
EPOCH_SECONDS = 4
EPOCH_SAMPLES = SAMPLING_RATE * EPOCH_SECONDS   # 512
BASELINE_SAMPLES = 3 * SAMPLING_RATE            # 384
WELCH_NPERSEG = 256
BANDPASS_LOW = 0.5
BANDPASS_HIGH = 45.0
NOTCH_FREQ = 50.0
NOTCH_Q = 30.0
FILTER_ORDER = 5
VARIANCE_THRESHOLD = 0.01
SELECT_K = 200
KNN_K = 7
CV_FOLDS = 5
SEED = 42
LABEL_SMOOTHING = 0.1
EARLY_STOP_PATIENCE = 15
EARLY_STOP_MIN_DELTA = 1e-4
LEARNING_RATE = 1e-4
MAX_EPOCHS = 100
ROC_MAX_POINTS = 50
TOP_ATTRIBUTIONS = 20
ARTIFACT_MIN_CHANNELS = 20
ARTIFACT_MAX_FLAGGED = 3

# FIXED VALUES: frequency bands, closed intervals in Hz, in this order.
BANDS = [
    ("delta", 0.5, 4.0),
    ("theta", 4.0, 8.0),
    ("alpha", 8.0, 13.0),
    ("beta", 13.0, 30.0),
    ("gamma", 30.0, 45.0),
]

# FIXED VALUES: left/right frontal electrode pairs, in priority order.
FRONTAL_PAIRS = [("F3", "F4"), ("Fp1", "Fp2"), ("AF3", "AF4")]

# FIXED VALUES: class levels.
LEVELS = [(0, "Low"), (1, "Moderate"), (2, "High")]

# FIXED VALUES: known channel names, in the order used to attribute a feature
# name to its channel (the first listed name contained in the feature wins).
CHANNELS = [
    "Fp1", "Fp2", "AF3", "AF4", "F3", "F4", "F7", "F8",
    "FC1", "FC2", "FC5", "FC6", "C3", "C4", "T7", "T8",
    "CP1", "CP2", "CP5", "CP6", "P3", "P4", "P7", "P8",
    "PO3", "PO4", "O1", "O2", "Fz", "Cz", "Pz", "Oz",
]

# FIXED VALUES: per-dataset rating threshold for the 3-level label.
LABEL_THRESHOLDS = {"DEAP": 5.0, "DREAMER": 2.5, "MAHNOB": 5.0}

# FIXED VALUES: the datasets: label threshold, highest rating, EEG channels kept, sampling rate of the recordings in Hz.
DATASETS = {
    "DEAP": {"threshold": 5.0, "max_rating": 9, "channels": 32, "rate": 128},
    "DREAMER": {"threshold": 2.5, "max_rating": 5, "channels": 14, "rate": 128},
    "MAHNOB": {"threshold": 5.0, "max_rating": 9, "channels": 32, "rate": 256},
}

# FIXED VALUES: admitted upload extensions (lower case).
ADMITTED_EXTENSIONS = [".csv", ".edf", ".bdf", ".dat"]

# FIXED VALUES: Daubechies-4 analysis low-pass taps; the high-pass taps follow
# by the quadrature-mirror rule g[j] = (-1)**(j+1) * h[7-j].
DB4_LOW = [
    -0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309,
    -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965,
]
DB4_HIGH = [(-1) ** (j + 1) * DB4_LOW[7 - j] for j in range(8)]
