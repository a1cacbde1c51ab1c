import numpy as np
import pytest


@pytest.fixture
def rng():
    return np.random.default_rng(11)


@pytest.fixture
def vectors(spark):
    """A table of (id, v, extras with clashing names) from an id-to-vector mapping."""

    def make(rows):
        schema = "id long, v array<float>, stratum int, block int, key string, part long"
        return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "k", 3) for i, v in rows], schema)

    return make
