"""Thresholds and defaults, a name for each use: some include their bound and some do not."""

BACKING_AT_MOST = 0.05  # squared residual, inclusive
TENSION_ABOVE = 0.05  # squared residual, exclusive
CONTRADICTION_ABOVE = 0.05  # squared residual of a propagated edge, exclusive
AGREE_BELOW = 0.05  # absolute difference, exclusive
RESOLVED_BELOW = 0.1  # squared residual after rewriting, exclusive
DISAGREES_ABOVE = 0.30  # absolute residual of a prior claim at a new finding, exclusive
SURVIVES_ABOVE = 1e-4  # squared residual in the cost comparison, exclusive
POSITIVE_FROM = 0.5
SUSPECT_FROM_PAPERS = 2
COHERENT_FROM_SHARED = 2

LAMBDA_FLAT = 1.0
LAMBDA_BASE = 1.0
ALPHA = 8.0
INCOMING_DISCOUNT = 0.3
SWEEP = (1.0, 2.0, 4.0, 6.0, 8.0, 10.0, 12.0)
OUT_STRENGTHS = (1.0, 0.8, 0.6, 0.4, 0.2, 0.0)
IMPROVES_BY = 1e-12
TOP_STATURE = 8
PALETTE_SIZE = 14
