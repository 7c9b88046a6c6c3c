"""Page quality gate (OP-32, OP-33) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published model and scaler.
WEIGHTS = (
    0.54302840666144747139298942784080, 0.75649022449945557688977260113461, 0.55739253564494073422963538178010, -10.61482526991066066557323210872710, 13.77788509717442104622499605484307,
    -0.15131131902733202521105226878717, -1.65816301407947652712948638509260, 0.14645759884997475164247759948921, -0.22028772959742293213736274992698, 0.69666588705777821033393593097571,
)
BIAS = 4.93199218164410613240988823235966
CENTRES = (72.0, 3964.0, 177.0, 663.0, 264.0, 0.1987315010570824, 0.4294871794871794, 69.0, 42.0, 18.0)
SCALES = (864.0, 3939.0, 531.0, 1268.0, 349.0, 0.6509677419354839, 0.2768566281830836, 30.0, 30.0, 11.0)
THRESHOLD = 0.4
MIN_TOKENS = 150
# End of fixed values.


def features(dom_depth: Column, tag_count: Column, url_count: Column, tokens: Column, unique: Column, url_len: Column, path_len: Column, host_len: Column) -> list[Column]:
    """OP-32: ten features; a ratio over 0 is null."""
    d = lambda c: c.cast("double")
    ratio = lambda a, b: F.when(b != 0, d(a) / d(b))
    return [d(dom_depth), d(tag_count), d(url_count), d(tokens), d(unique), ratio(tokens, url_count), ratio(unique, tokens), d(url_len), d(path_len), d(host_len)]


def score(features: list[Column]) -> Column:
    """OP-33: the probability of a good page. No links make the sixth feature infinite, and its weight is negative: 0."""
    z = F.lit(BIAS)
    for f, w, c, s in zip(features, WEIGHTS, CENTRES, SCALES, strict=True):
        z = z + w * (f - c) / s
    stable = F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))
    return F.when(features[5].isNull() | features[6].isNull(), 0.0).otherwise(stable)


def skipped(score: Column, tokens: Column) -> Column:
    """Whether a page is left out of the index: of the bad class, and short."""
    return (score < THRESHOLD) & (tokens < MIN_TOKENS)
