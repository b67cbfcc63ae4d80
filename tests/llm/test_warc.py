import hashlib
import random
import time

from hypothesis import given, settings, strategies as st

from tessera.llm import warc as W


def rec(i, payload, kind="response"):
    return W.record(kind, i, f"http://h/{i}", payload, hashlib.sha256(payload).hexdigest(), len(payload), 1 if kind == "revisit" else None)


def covered(data):
    found = list(W.salvage(data))
    at = 0
    for f in found:
        if f.start != at:
            assert f.start < at and f.inner is not None  # further in the same member
        else:
            at += f.n
    assert at == len(data)
    return found


def test_damage_is_cut_out():
    r = random.Random(3)
    bodies = [r.randbytes(r.randrange(3000)) for _ in range(12)]
    parts = [W.gzipped(rec(i, b)) if i % 3 else rec(i, b) for i, b in enumerate(bodies)]
    whole = b"".join(parts)
    assert [f.payload for f in covered(whole)] == bodies
    for hit in (1, 3, 4, 11):
        bad = list(parts)
        x = bytearray(bad[hit])
        x[len(x) // 2] ^= 0x55
        bad[hit] = bytes(x)
        found = covered(b"".join(bad))
        assert [f.payload for f in found if f.kind != "gap"] == [b for i, b in enumerate(bodies) if i != hit]
        gap, = [f for f in found if f.kind == "gap"]
        assert gap.start == sum(map(len, parts[:hit])) and gap.n == len(parts[hit]) and gap.reason
    found = covered(b"noise" + whole[:-7])  # only the last member's sum is cut
    assert [f.payload for f in found if f.kind != "gap"] == bodies and [f.kind for f in found].count("gap") == 2
    found = covered(b"noise" + whole[: -len(parts[-1]) // 2])
    assert [f.payload for f in found if f.kind != "gap"] == bodies[:-1] and [f.kind for f in found].count("gap") == 2


def test_damage_within_a_member():
    bodies = [b"first" * 400, b"second" * 300, b"third" * 500]
    parts = [rec(i, b) for i, b in enumerate(bodies)]
    bad = parts[1].replace(b"second", b"sXcond", 1)
    found = covered(W.gzipped(parts[0] + bad + parts[2]) + W.gzipped(rec(9, b"after")))
    assert [(f.kind, f.payload) for f in found] == [("response", bodies[0]), ("gap", b""), ("response", bodies[2]), ("response", b"after")]
    assert (found[1].inner, found[1].inner_n, found[1].reason) == (len(parts[0]), len(bad), "wrong digest") and found[0].reason is None
    whole = W.gzipped(b"".join(parts))
    found = covered(whole[:-4] + W.gzipped(rec(9, b"after")))
    assert [f.payload for f in found if f.kind != "gap"] == [*bodies, b"after"] and found[0].reason and found[-1].reason is None
    r = random.Random(1)
    noisy = [rec(i, r.randbytes(40000)) for i in range(3)]
    whole = bytearray(W.gzipped(b"".join(noisy)))
    whole[100000:] = whole[100500:]
    found = covered(bytes(whole) + W.gzipped(rec(9, b"after")))
    assert [f.fields["warc-record-id"] for f in found if f.kind != "gap"] == ["<urn:page:0>", "<urn:page:1>", "<urn:page:9>"]
    cut = W.gzipped(b"".join(noisy))[:-4]
    assert [f.kind for f in covered(cut)].count("response") == 3
    sums = bytearray(W.gzipped(b"".join(parts)))
    sums[-6] ^= 1
    assert [f.reason for f in covered(bytes(sums))] == ["member: wrong sum"] * 4


def test_long_headers(spark):
    rows = [(1, "http://h/" + "x" * (1 << 20), "a" * 150), (2, "http://h/2", "a" * 150), (3, "é" * 70000, "b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((x.page_id, x.record_type) for x in W.round_trip(df).collect()) == [(1, "response"), (2, "revisit"), (3, "response")]
    got = {x.page_id: x.url for x in W.read(W.archived(df)).collect()}
    assert got == {i: u for i, u, _ in rows}
    began = time.monotonic()
    covered(b"WARC/1.0\r\nx: y\r\n" * 100000)
    assert time.monotonic() - began < 20


def test_a_false_start_in_a_payload_does_not_hide_the_rest():
    inner = rec(7, b"inside")
    data = rec(1, b"x" * 50 + inner + b"\x1f\x8b\x08junk") + rec(2, b"next")
    assert [f.fields["warc-record-id"] for f in covered(data)] == ["<urn:page:1>", "<urn:page:2>"]


@settings(deadline=None, max_examples=80)
@given(st.binary(max_size=200), st.integers(0, 400), st.integers(1, 60))
def test_any_bytes_are_covered(noise, at, n):
    data = W.gzipped(rec(1, b"abc" * 40)) + rec(2, b"WARC/1.0\r\n") + W.gzipped(rec(3, b"z"))
    covered(data[:at] + noise + data[at + n :])


def test_round_trip(spark):
    big, small = "é" * 60, "tiny"
    rows = [(5, "http://a b", big), (3, None, big), (9, "u\r\nX: y", big), (4, "u", small), (2, "u", small), (7, "u", None), (8, "u", ""), (None, "u", "n" * 200), (1, "u", "n" * 200), (6, "u", "p" * 120), (6, "u", "p" * 120)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted(map(repr, (tuple(r) for r in W.round_trip(df).collect())))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, g in rows if g == h and j is not None] if len(b) >= 100 else []
        first = min(same) if len([1 for _, _, g in rows if g == h]) > 1 and same else None
        again = first is not None and i != first
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(map(repr, want))
    assert W.round_trip(df.limit(0)).collect() == []


def test_files_with_damage(spark, tmp_path):
    data = W.gzipped(rec(1, b"one")) + b"\x1f\x8b\x08broken" + W.gzipped(rec(2, b"two", "revisit"))
    (tmp_path / "a.warc.gz").write_bytes(data)
    got = W.read_files(spark, str(tmp_path)).orderBy("start").collect()
    assert [(r.kind, r.page_id, r.payload) for r in got] == [("response", 1, b"one"), ("gap", None, None), ("revisit", 2, None)]
    assert got[1].n == 9 and got[2].refers_to == 1
