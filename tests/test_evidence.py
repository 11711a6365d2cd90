"""A folder of mixed files, each with its records or its fault."""

import json

from tracewell.sources import evidence

FILES = {
    "a.csv": 'id,note\n1,"x,\ny"\n , \n2\n3,4,5\n'.encode(), "b.TSV": b"id\tnote\n1\tx, y\n", "c.json": b'[{"a": 1}, {"a": {"b": 2}}]', "d.json": b'[1, null, "x"]', "e.json": b'{"records": 5, "rows": [{"a": 1}]}', "f.json": '{"a": "é"}'.encode("utf-16"),
    "g.jsonl": b'{"a": 1}\n\n{"a": 2}\nbroken', "h.txt": b"one\ntwo\n\n\n\nthree\n", "i": b"x,y\n1,2\n", "j": b"x\ty\n1\t2\n", "k": b'{"a": 1}\n{"a": 2}\n', "l": b'{"a":\n [1]}', "m": b"just words", "n": b"  %PDF-1.4", "o.csv": b"id,note\n,\n", "p.csv": b" \n", "q.json": b"[]", "r.json": b"7",
    "s.txt": b"caf\xe9", "u.json": b"[1", "v.csv": b"a,b\n" + b"1,2\n" * 400,
}


def test_mixed_folder(spark, tmp_path):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    got: dict = {}
    for r in evidence.read(spark, str(tmp_path), most=1500).orderBy("record_no").collect():
        got.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["format"], json.loads(r["raw"]) if r["raw"] else r["error"]))
        assert (r["record_no"] is None) == (r["error"] is not None) and (r["error"] is None or r["error"] in evidence.FAULTS)
    kinds = {k: {x for x, _ in v} for k, v in got.items()}
    rows = {k: [x for _, x in v] for k, v in got.items()}
    assert rows["a.csv"] == [{"id": "1", "note": "x,\ny"}, {"id": "2", "note": ""}, {"id": "3", "note": "4", "": ["5"]}]
    assert rows["b.TSV"] == [{"id": "1", "note": "x, y"}] and rows["c.json"] == [{"a": 1}, {"a": {"b": 2}}] and rows["d.json"] == [{"value": 1}, {"value": "x"}] and rows["e.json"] == [{"a": 1}] and rows["f.json"] == [{"a": "é"}]
    assert rows["g.jsonl"] == ["invalid_json", {"a": 1}, {"a": 2}] and rows["h.txt"] == [{"text": "one\ntwo"}, {"text": "three"}] and rows["s.txt"] == [{"text": "café"}]
    assert (kinds["i"], kinds["j"], kinds["k"], kinds["l"]) == ({"csv"}, {"tsv"}, {"jsonl"}, {"json"}) and len(rows["k"]) == 2 and rows["l"] == [{"a": [1]}]
    faults = {k: rows[k] for k in "m n o.csv p.csv q.json r.json u.json v.csv".split()}
    assert faults == {"m": ["unknown_format"], "n": ["unsupported_format"], "o.csv": ["no_rows"], "p.csv": ["empty_file"], "q.json": ["no_records"], "r.json": ["no_records"], "u.json": ["invalid_json"], "v.csv": ["too_large"]}
    assert got.keys() == FILES.keys()
    assert list(evidence.records_of("t.txt", b"")) == [("txt", None, None, "empty_file")]
