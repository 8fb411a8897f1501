import hashlib

import xxhash

from chronoset.functions import text as fn


def test_mask(spark):
    known = "PII_REDACTED_9f23fb7b90873516"
    cases = {"none": "none", "499118665246": known, "x499118665246y": f"x{known}y", "4991186652467": known + "7", "499118665246 499118665246": f"{known} {known}", "12345678901": "12345678901", "": ""}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r.t: r.m for r in df.select("t", fn.mask_pii("t").alias("m")).collect()}
    assert got == cases | {None: None}


def test_hash_is_xxh64():
    import numpy as np

    data = hashlib.sha256(b"x").digest()[:24]
    assert [int(h) for h in fn.xxh64_of_12(np.frombuffer(data, np.uint8))] == [xxhash.xxh64_intdigest(data[:12]), xxhash.xxh64_intdigest(data[12:])]


def test_hash_of_numbers_is_sparks(spark):
    import numpy as np

    values = [0, 1, -1, 7, 2**63 - 1, -(2**63), 123456789012345]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").selectExpr("xxhash64(v)").collect()]
    assert fn.xxh64_of_long(np.array(values)).view(np.int64).tolist() == want == [int.from_bytes(xxhash.xxh64_digest(v.to_bytes(8, "little", signed=True), seed=42), "big", signed=True) for v in values]


def test_times(spark):
    cases = {"2024-01-02T03:04:05Z": 1704164645000000000, "2024-01-02T03:04:05.123456789Z": 1704164645123456789, "2024-01-02T03:04:05.5+01:00": 1704161045500000000, "2024-01-02": None, "nonsense": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.n for r in df.select("t", fn.rfc3339_nanos("t").alias("n")).collect()} == cases
