"""The versioned store against random interleavings."""

import random

from quillmark.operators.versions import VersionedStore

SCHEMA = "k long, v string"


def rows(spark, d):
    return spark.createDataFrame(list(d.items()), SCHEMA)


def read(store, version=None):
    return {r.k: r.v for r in store.as_of(version).collect()}


def test_random_interleavings(spark, tmp_path):
    rng = random.Random(9)
    for run in range(3):
        store = VersionedStore(spark, f"file://{tmp_path}/{run}", "k", SCHEMA)
        state: dict[int, tuple[int, str | None]] = {}  # key -> (version, value)
        past, refresh = {0: {}}, None
        assert read(store) == {}
        for step in range(8):
            what = rng.choice(["put", "put", "delete", "begin", "end", "compact"])
            before = store.version()
            if what == "begin" or (what == "end" and refresh is None):
                refresh = (before, read(store))
                continue
            if what == "compact":
                store.compact()
                assert store.version() == before
                continue
            if what == "put":
                new = {rng.randrange(8): f"{step}-{rng.randrange(9)}" for _ in range(4)}
                version, seen = store.append(rows(spark, new)), before
            elif what == "delete":
                new = dict.fromkeys({rng.randrange(8) for _ in range(2)})
                version, seen = store.append(spark.createDataFrame([(k,) for k in new], "k long"), deletes=True), before
            else:  # a refresh that began a while ago writes what it made of the store of then
                seen, known = refresh
                new = {k: f"fresh {v}" for k, v in known.items()}
                version = store.append(rows(spark, new), seen=seen)
                refresh = None
            assert version == before + 1
            for k, v in new.items():
                if state.get(k, (0, None))[0] <= seen:
                    state[k] = (version, v)
            past[version] = {k: v for k, (_, v) in state.items() if v is not None}
            assert read(store) == past[version]
        for version, want in past.items():
            assert read(store, version) == want


def test_two_writers_get_two_versions(spark, tmp_path):
    a, b = (VersionedStore(spark, f"file://{tmp_path}/s", "k", SCHEMA) for _ in range(2))
    assert a._claim("marks", 1, "x 0") and not b._claim("marks", 1, "y 0")
    assert list(a._numbers("marks").values()) == ["x 0"]
