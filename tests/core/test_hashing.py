"""Test vectors of the hashes, and numpy against the column expressions."""

import numpy as np

from sluice.functions.hashing import with_bloom_columns, with_cms_columns
from sluice.operators.recovery import positions_of

VECTORS = {
    0: ([5443, 1406, 16044, 6061], [994, 403, 42, 236, 941, 599, 246, 98]),
    1: ([3320, 4325, 2564, 11473], [297, 364, 422, 872, 209, 114, 247, 732]),
    2: ([14734, 1932, 335, 1051], [500, 665, 329, 763, 27, 743, 949, 291]),
    42: ([13198, 7960, 10038, 3255], [895, 213, 686, 586, 183, 912, 71, 547]),
    12345: ([11268, 13004, 6690, 7933], [989, 217, 218, 683, 765, 259, 353, 154]),
    0x123456789ABCDEF0: ([8225, 4660, 6396, 4961], [142, 750, 88, 177, 865, 395, 25, 247]),
    -1: ([15587, 1181, 7614, 5231], [129, 630, 305, 775, 111, 355, 788, 76]),
}


def test_vectors(spark):
    df = spark.createDataFrame([(k,) for k in VECTORS], "key bigint")
    ansi = spark.conf.get("spark.sql.ansi.enabled")
    got = {r["key"]: (list(r["idx"]), list(r["cells"])) for r in with_bloom_columns(with_cms_columns(df)).collect()}
    assert got == VECTORS
    assert spark.conf.get("spark.sql.ansi.enabled") == ansi


def test_numpy_positions():
    keys = np.array(list(VECTORS), np.int64)
    got = positions_of(keys) - np.arange(4) * 16384
    assert got.tolist() == [v[0] for v in VECTORS.values()]
