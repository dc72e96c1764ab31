"""Published residue scales and panel constants, as plain values."""

ALPHABET = "ACDEFGHIKLMNPQRSTVWY"

# Kyte and Doolittle 1982, hydropathy.
HYDROPATHY = {"A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8, "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3}

# Eisenberg 1984, consensus hydrophobicity.
EISENBERG = {"A": 0.62, "C": 0.29, "D": -0.90, "E": -0.74, "F": 1.19, "G": 0.48, "H": -0.40, "I": 1.38, "K": -1.50, "L": 1.06, "M": 0.64, "N": -0.78, "P": 0.12, "Q": -0.85, "R": -2.53, "S": -0.18, "T": -0.05, "V": 1.08, "W": 0.81, "Y": 0.26}

# Fauchère and Pliska 1983, octanol-water.
OCTANOL = {"A": 0.31, "C": 1.54, "D": -0.77, "E": -0.64, "F": 1.79, "G": 0.00, "H": 0.13, "I": 1.80, "K": -0.99, "L": 1.70, "M": 1.23, "N": -0.60, "P": 0.72, "Q": -0.22, "R": -1.01, "S": -0.04, "T": 0.26, "V": 1.22, "W": 2.25, "Y": 0.96}

# Boman 1996, protein binding, kcal/mol, sign flipped.
BOMAN = {"A": -1.81, "C": -1.28, "D": 8.72, "E": 6.81, "F": -2.98, "G": -0.94, "H": 4.66, "I": -4.92, "K": 5.55, "L": -4.92, "M": -2.35, "N": 6.64, "P": 0.00, "Q": 5.54, "R": 14.92, "S": 3.40, "T": 2.57, "V": -4.04, "W": -2.33, "Y": -0.14}

# Pace and Scholtz 1998, helix propensity, kcal/mol.
HELIX = {"A": 0.0, "C": 0.68, "D": 0.69, "E": 0.40, "F": 0.54, "G": 1.0, "H": 0.61, "I": 0.41, "K": 0.26, "L": 0.21, "M": 0.24, "N": 0.65, "P": 3.16, "Q": 0.39, "R": 0.21, "S": 0.50, "T": 0.66, "V": 0.61, "W": 0.49, "Y": 0.53}

# pKa of side chains that gain charge and that lose it, and of the ends.
PKA_POSITIVE = {"H": 6.00, "K": 10.53, "R": 12.48}
PKA_NEGATIVE = {"C": 8.18, "D": 3.65, "E": 4.25, "Y": 10.07}
PKA_FIRST, PKA_LAST = 8.0, 3.65

# Classes of residues.
POSITIVE, NEGATIVE, HYDROPHOBIC, AROMATIC, SMALL = "KR", "DE", "AILMFWVY", "FWY", "AGST"
SHEET_PRONE, SHEET_FORMERS, ASPARTIMIDE = "AILMFVWCY", "IVTYFW", "GASTCRDN"

# Edges of the three cell axes.
LENGTH_EDGES = [12, 16, 20, 25, 32, 40]
CHARGE_EDGES = [0.5, 2.5, 4.5, 6.5, 8.5, 11.5]
MOMENT_EDGES = [0.22, 0.34, 0.47]

# Strains of the panel by head, and the resistant ones.
PANEL = {"mic_ecoli": 5, "mic_paeru": 3, "mic_kpneu": 2, "mic_abaum": 2, "mic_saure": 2, "mic_efaec": 2, "mic_bsubt": 1}
RESISTANT = {"mic_abaum": 1, "mic_ecoli": 2, "mic_kpneu": 1, "mic_paeru": 1, "mic_saure": 1, "mic_efaec": 2}
PANEL_NEGATIVE = ["mic_ecoli", "mic_paeru", "mic_kpneu", "mic_abaum"]
PANEL_POSITIVE = ["mic_saure", "mic_efaec", "mic_bsubt"]
POOLED_NEGATIVE, POOLED_NEGATIVE_STRAINS = "mic_gram_neg", 3

# Weights of the coarse and the library quality, and of the objectives:
# mean potency, worst strain, safety, activity, envelope, risk.
COARSE = {"amp": 1.20, "potency": -0.45, "surrogate": -0.90, "safe": 0.55, "buildable": 0.40, "risk": -0.30, "reuse": -0.90}
OBJECTIVES = {
    "broad_spectrum": (-1.40, -0.70, 1.70, 0.60, 1.50, -1.10),
    "gram_pos": (-1.80, -0.60, 1.50, 0.50, 1.30, -1.10),
    "gram_neg": (-1.80, -0.70, 1.50, 0.50, 1.30, -1.10),
    "mdr": (-1.70, -0.80, 1.50, 0.50, 1.40, -1.20),
}
DEFAULT_OBJECTIVE = "broad_spectrum"
SAFETY_FLOOR = 0.5
BLEND_WEIGHT, BLEND_PENALTY = 0.45, 0.25

# Terms of the envelope: weight, lower and upper end, width of the slopes.
ENVELOPE = {
    "eisenberg": (2.0, -0.40, 0.10, 0.25),
    "gravy": (2.0, -1.20, 0.30, 0.50),
    "hydrophobic": (1.5, 0.33, 0.50, 0.10),
    "charge_density": (1.5, 0.28, 0.55, 0.10),
    "leu": (1.0, 0.0, 0.15, 0.08),
    "lys": (1.0, 0.18, 0.60, 0.08),
    "arg_share": (0.8, 0.0, 0.50, 0.25),
    "aromatic": (0.6, 0.0, 0.20, 0.10),
    "length": (1.2, 12, 22, 4),
}

# Multipliers and masks of the four hashes of a sketch, and how they fold.
SKETCH = [
    (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9),
    (0x94D049BB133111EB, 0xD6E8FEB86659FD93),
    (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9),
    (0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63),
]
SKETCH_START, SKETCH_FACTOR = 1469598103934665603, 1099511628211
