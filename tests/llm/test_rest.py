"""Archives, secrets, quality and the pipeline."""

import base64
import gzip
import hashlib
import random
import re
from collections import Counter
from itertools import product
from pathlib import Path

import numpy as np
import pytest

from tracewell.llm import quality, secrets, warc
from tracewell.llm.common import scratch


def record(i, payload, kind="response"):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    digest = base64.b32encode(hashlib.sha1(block).digest())
    return b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:x-page:%d>\r\nContent-Type: application/http\r\nWARC-Block-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind.encode(), i, digest, len(block), block)


def read(data):
    return [("gap", o, n, why) if h is None else (int(re.findall(r"\d+", h["warc-record-id"])[0]), o, n, b) for o, n, h, b, why in warc.salvage(data)]


@pytest.mark.parametrize("pack", [bytes, lambda r: gzip.compress(r, mtime=0)])
def test_salvage(pack):
    recs = [pack(record(i, b"page %d " % i * 30 + (b"WARC/1.0\r\n" if i == 2 else b""))) for i in range(6)]
    assert [x[0] for x in read(b"".join(recs))] == list(range(6))
    size = [len(r) for r in recs]
    bad = bytearray(recs[1])
    bad[len(bad) // 2] ^= 0xFF
    got = read(b"".join([recs[0], bytes(bad), b"junk", *recs[2:4], recs[4][: size[4] // 2], recs[5]]))
    assert [x[0] for x in got] == [0, "gap", 2, 3, "gap", 5]
    assert got[1][1:3] == (size[0], size[1] + 4)  # the damaged record and the junk after it
    assert got[4][2] == size[4] // 2
    assert [x[0] for x in read(b"xx" + recs[0])] == ["gap", 0]
    # of a member that lacks its end, the whole record is kept
    assert [x[0] for x in read(recs[0] + recs[1][:-9])] == ([0, "gap"] if pack is bytes else [0, 1, "gap"])
    assert read(b"") == []


def test_quoted_records_are_not_taken():
    inner = record(7, b"quoted")
    recs = [record(0, b"a" * 50), record(1, b"start " + inner + b" end"), record(2, b"c")]
    hurt = bytearray(b"".join(recs))
    hurt[len(recs[0]) + recs[1].index(b"start")] ^= 1
    assert [x[0] for x in read(bytes(hurt))] == [0, "gap", 2]
    assert [x[0] for x in read(b"".join(gzip.compress(r, 0) for r in recs))] == [0, 1, 2]


def test_one_damaged_byte_costs_one_record(spark):
    pages = spark.createDataFrame([(i, f"http://{i}", f"page {i} " * (i % 50)) for i in range(300)], "page_id long, url string, html string")
    path = scratch(spark, "t")
    warc.write_archives(pages.repartition(1), path)
    (file,) = Path(path.removeprefix("file:")).glob("part-*")
    data = bytearray(file.read_bytes())
    assert gzip.decompress(bytes(data)).count(b"WARC/1.0") == 300
    data[len(data) // 3] ^= 0x55
    hurt = scratch(spark, "t").removeprefix("file:")
    Path(hurt).mkdir(parents=True)
    (Path(hurt) / "one.warc.gz").write_bytes(data)
    got = warc.read_archives(spark, hurt).collect()
    whole = {tuple(r) for r in warc.pages_of(warc.read_archives(spark, path)).collect()}
    left = {tuple(r) for r in warc.pages_of(warc.read_archives(spark, hurt)).collect()}
    assert left < whole and len(whole - left) == 1
    (gap,) = [r for r in got if r["gap"]]
    assert gap["offset"] <= len(data) // 3 < gap["offset"] + gap["length"]


def test_salvage_of_a_member_with_many_records():
    data = gzip.compress(b"".join(record(i, bytes(random.Random(i).choices(range(256), k=9000))) for i in range(6)), mtime=0)
    cut_off, hurt = data[: len(data) * 2 // 3], bytearray(data)
    hurt[len(data) // 2] ^= 0xFF
    assert [x[0] for x in read(cut_off + data)] == [0, 1, 2, "gap", *range(6)]
    got = [x[0] for x in read(bytes(hurt) + data)]
    assert got[-7:] == ["gap", *range(6)] and got[:-7] == list(range(len(got) - 7)) and len(got) > 8


@pytest.mark.parametrize("few", [200_000, 0])
def test_archives(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "BROADCAST", few)
    rows = [(5, "http://a", "<p>é</p>"), (9, "http://b", "<p>é</p>"), (7, None, "<p>é</p>"), (1, "http://c\r\nX: y", ""), (2, "u", None), (3, "u", "WARC/1.0\r\nnot a record\r\n\r\n"), (None, "u", "alone"), (-4, "u", "x" * 300_000), (None, "v", "two"), (12, "v", "two")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    path = scratch(spark, "t")
    warc.write_archives(pages, path)
    got = warc.read_archives(spark, path)
    assert got.where("gap is not null").count() == 0
    top = {}
    for p, _, h in rows:
        top[h or ""] = max(top.get(h or "", -(2**70)), p if p is not None else -(2**69))
    want = Counter()
    for p, _, h in rows:
        data, t = (h or "").encode(), top[h or ""]
        first = (p if p is not None else -(2**69)) == t
        want[p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else t] += 1
    assert Counter(map(tuple, warc.pages_of(got).collect())) == want
    small = scratch(spark, "t")
    warc.write_archives(pages, small, least=100)
    assert Counter(r["record_type"] for r in warc.pages_of(warc.read_archives(spark, small)).collect()) == {"response": len(rows)}
    none = scratch(spark, "t")
    warc.write_archives(pages.limit(0), none)
    assert warc.read_archives(spark, none).count() == 0


def brute_base(text):
    out = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))


def secret_texts(n):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghilmnorstu") for _ in range(rnd.randint(2, 9)))
    code = lambda k, a="0123456789abcdef": "".join(rnd.choice(a) for _ in range(k))
    kinds = [lambda: f"password={code(18)}", lambda: f'token = "{code(40)}"', lambda: "AKIA" + code(16, "ABCDEFGHIJKLMNOP0123456789"), lambda: f"{code(3, '0123456789')}-{code(4, '0123456789')}", lambda: f"{word()}.{code(2)}@mail.example", lambda: f"api_key: short{code(3)}", lambda: "(555) 10.2.3.4", lambda: f"APIKEY:{code(13, 'ABCdef+/_.=-')}"]
    return [" ".join([*(word() for _ in range(rnd.randint(3, 30))), rnd.choice(kinds)(), *(word() for _ in range(5)), rnd.choice(kinds)(), word()]) for _ in range(n)]


def test_secrets(spark, docs, rows, no_docs):
    texts = [*secret_texts(300), *[t for _, t in rows], "secret: token: abcdefghijklmnop", "AKIAAKIA12", "token=" * 5 + "a" * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    crf = secrets.learn(df)
    assert crf.weights
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secrets.scan(df, crf).collect()}
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[2] != "crf"] == brute_base(t or "")
        base = brute_base(t or "")
        assert all(not (a < e and s < b) for s, e, k in got[i] if k == "crf" for a, b, _ in base)
    # what the patterns miss, after a key word
    assert [[k for *_, k in x] for x in secrets.all_spans(["lorem the password is: Zk9xQw3rty77ab0123 ipsum", None, "lorem ipsum dolor 10.2.3.4 sit amet"], crf)] == [["crf"], [], []]
    assert secrets.scan(no_docs, secrets.learn(no_docs)).count() == 0
    clean = secrets.redact(docs, crf)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert not [r for r in clean.collect() if r["text"] and brute_base(r["text"])]
    assert all(r["n_chars"] == len(r["text"]) for r in clean.collect() if r["text"])


def worth(crf, emit, tags):
    if tags[0] == 1 or (2, 1) in zip(tags, tags[1:]):
        return -1e9
    return sum(e[t] for e, t in zip(emit, tags)) + sum(crf.steps[a][b] for a, b in zip(tags, tags[1:]))


def test_viterbi_is_the_best_sequence():
    rnd = random.Random(8)
    for _ in range(50):
        crf = secrets.Field({}, [[rnd.gauss(0, 1) for _ in range(3)] for _ in range(3)])
        emit = np.array([[rnd.gauss(0, 2) for _ in range(3)] for _ in range(6)])
        assert worth(crf, emit, crf.tags(emit)) == pytest.approx(max(worth(crf, emit, t) for t in product(range(3), repeat=6)))


def test_batches_decode_like_whole_texts(spark):
    """Scores of a batch are those of the features, and stretches between certain tokens give the best sequence of the whole."""
    crf = secrets.learn(spark.createDataFrame(list(enumerate(secret_texts(300))), "doc_id long, text string"))
    texts = [*secret_texts(60), "password correct-horse-battery-staple and two.part.secret", "", "a\u00a0b key:\u3000x" + "y" * 30, "secret: " + "abcdefghijklmnopqrstuvwx" * 2]
    d = secrets.Decoder(crf)
    emit, text, start, end = d.scores(texts)
    for i, t in enumerate(texts):
        tokens = [(m.start(), m.end(), m[0]) for m in secrets._TOKEN.finditer(t)]
        own = text == i
        assert [x[:2] for x in tokens] == list(zip(start[own].tolist(), end[own].tolist()))
        want = np.array([crf.score(f) for f in secrets.features(tokens, secrets.file_features(t))]).reshape(-1, 3)
        assert np.allclose(emit[own], want)
        spans, at = [], None
        for (s, e, _), tag, (_, before, _) in zip([*tokens, (0, 0, "")], [*crf.tags(want), 2], [(0, 0, ""), *tokens]):
            if at is not None and tag != 1:
                spans.append((at, before))
                at = None
            at = s if tag == 0 else at
        assert d.spans(texts)[i] == spans


def test_long_texts_decode_like_short_ones(spark):
    """Parts of any size, and texts of over BLOCK characters, have the spans of the text scored at once."""
    rnd = random.Random(12)
    some = secret_texts(400)
    crf = secrets.learn(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"))
    d = secrets.Decoder(crf)
    texts = [" ".join(rnd.sample(some, 12)) for _ in range(6)] + ["\u3000".join(some[:20]), "x" * 3000 + " the password is: Zk9xQw3rty77ab0123", ("a=b " * 700) + "\n\n" + some[3], "   ", "?" * 999]
    found = 0
    for t in texts:
        want = d.spans([t])[0]
        found += len(want)
        for block in (1, 7, 64, 300, 5000):
            assert d.long_spans(t, block) == want, block
    assert found > 20
    long = " ".join(some * 18)
    assert len(long) > secrets.BLOCK
    want = [(s, e, "crf") for s, e in d.spans([long])[0]]
    base = brute_base(long)
    assert secrets.all_spans([long], crf)[0] == sorted([*base, *(x for x in want if not any(a < x[1] and x[0] < b for a, b, _ in base))], key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def test_gradient_of_the_field():
    rnd = random.Random(3)
    examples = [([[f"f{rnd.randrange(5)}" for _ in range(3)] for _ in range(n)], [2, 0, 1, 1, 2, 0][:n]) for n in (6, 3, 1)]
    data = secrets.Training(examples)
    w, steps = np.random.default_rng(1).normal(size=(len(data.names), 3)), np.random.default_rng(2).normal(size=(3, 3))
    value, grad, gstep = data.loss(w, steps)
    # the likelihood by all tag sequences
    total = data.ridge / 2 * ((w**2).sum() + (steps**2).sum())
    crf = secrets.Field({}, steps.tolist())
    for f, tags in examples:
        emit = np.array([sum(w[data.names[n]] for n in x) for x in f])
        each = [worth(crf, emit, t) for t in product(range(3), repeat=len(f))]
        total += np.logaddexp.reduce([x for x in each if x > -1e8]) - worth(crf, emit, tags)
    assert value == pytest.approx(total)
    for i in range(3):
        for arr, g in ((w, grad), (steps, gstep)):
            if arr is steps and i == 1:
                continue
            old = arr[i % len(arr), i]
            arr[i % len(arr), i] = old + 1e-5
            up = data.loss(w, steps)[0]
            arr[i % len(arr), i] = old - 1e-5
            down = data.loss(w, steps)[0]
            arr[i % len(arr), i] = old
            assert (up - down) / 2e-5 == pytest.approx(g[i % len(arr), i], abs=1e-4)


def hidden(n, seed):
    """Texts with secrets whose patterns are hidden, and where they are."""
    rnd, out = random.Random(seed), []
    for t in secret_texts(n):
        m = re.search("password=([0-9a-f]{18})|APIKEY:(\\S+)", t)
        if m:
            code = "".join(rnd.choice("abcdefghijkXYZ0123456789") for _ in range(20))
            out.append((t[: m.start()] + "password is " + code + t[m.end() :], m.start() + 12, m.start() + 32))
    return out


def test_field_finds_hidden_secrets(spark):
    crf = secrets.learn(spark.createDataFrame(list(enumerate(secret_texts(400))), "doc_id long, text string"))
    rows = hidden(400, 5)
    found = secrets.all_spans([t for t, *_ in rows], crf)
    hit = sum(any(k == "crf" and s < b and a < e for s, e, k in f) for f, (_, a, b) in zip(found, rows))
    crf_spans = [(s, e, a, b) for f, (_, a, b) in zip(found, rows) for s, e, k in f if k == "crf"]
    right = sum(s < b and a < e for s, e, a, b in crf_spans)
    assert len(rows) > 50 and hit > 0.75 * len(rows) and right > 0.9 * len(crf_spans)


def test_quality(spark, docs, no_docs):
    rnd = random.Random(2)
    good = lambda: " ".join("".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(2, 8))) for _ in range(60)) + "."
    rows = [(i, good() if i % 3 else rnd.choice([good().upper().replace(" ", "!! "), good().replace(" ", " | "), "same " * 60])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(900)] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    rules = quality.learn(df, labels)
    assert 0 < len(rules.rules) < 200 and all(1 <= len(c) <= quality.DEPTH for c, _ in rules.rules)
    out = quality.scored(df, rules).collect()
    held = [r for r in out if r["held_out"]]
    assert 100 < len(held) < 400
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held) > 0.97 * len(held)
    # the compiled expression equals the rules by hand
    v = np.array([quality.statistics(t) for _, t in rows])
    for r, x in zip(sorted(out, key=lambda r: r["doc_id"]), v):
        m = rules.intercept + sum(w for c, w in rules.rules if all((x[quality.STATISTICS.index(n)] > b) == above for n, above, b in c))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-m)))
    many = quality.scored(docs, rules)
    assert many.count() == docs.count() and many.where("score is null or predicted is null or held_out is null").count() == 0
    assert quality.scored(no_docs, rules).count() == 0
    one = quality.learn(df, labels.where("quality = 1"))
    assert {r["predicted"] for r in quality.scored(docs, one).collect()} == {1}
    assert quality.learn(df, labels.limit(0)).rules == []
    assert quality.accepted(docs, one).columns == docs.columns and quality.accepted(docs, one).count() == docs.count()


def test_pipeline(spark, tmp_path, docs, rows):
    import corpus_pipeline

    passage = "ba ra te li mo st kora koli komo kost kote bara"
    docs.unionByName(docs.selectExpr("doc_id + 1000 as doc_id", f"'{passage} ' || substr(text, 1, 200) as text", "lang", "source", "n_chars", "score", "n_tokens", "`group`", "fp").limit(9)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = at
        at = corpus_pipeline.staged(stage(spark, at, str(tmp_path)), name)
        if name != "packing":
            assert at.columns == docs.columns and at.count() <= before.count()
        if name == "decontamination":
            assert not [r for r in at.collect() if r["text"] and passage in r["text"].lower()]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at.count()


def test_salvage_of_neighbouring_damaged_members():
    def record(k):
        return b"WARC/1.0\r\nWARC-Record-ID: <urn:x-page:%d>\r\nContent-Length: 2000\r\n\r\n" % k + bytes((k * 7 + i * i) % 251 for i in range(2000)) + b"\r\n\r\n"

    def damaged(*ks):
        return gzip.compress(b"".join(map(record, ks)) + b"no record")

    buf = damaged(1, 2) + damaged(3, 4) + gzip.compress(record(5) + record(6))[:-6]
    got = list(warc.salvage(buf))
    assert [h["warc-record-id"] for _, _, h, _, _ in got if h] == [f"<urn:x-page:{k}>" for k in range(1, 7)]
    assert sum(h is None for _, _, h, _, _ in got) == 3
