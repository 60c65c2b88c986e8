"""Readers and shards on small files."""

import bz2
import gzip
import io
import json
import lzma
import sqlite3
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.errors import DatasetDecodeError, DatasetError, DatasetFormatError, EmptySplitError, VerificationError
from millrace.operators import chat
from millrace.sources import readers, shards

DOCX = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>'


def docx() -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", DOCX)
    return b.getvalue()


@pytest.fixture
def corpus(tmp_path):
    (tmp_path / "a.txt").write_bytes("alpha\rbeta\n".encode())
    (tmp_path / "_b.txt.xz").write_bytes(lzma.compress("größer".encode()))
    (tmp_path / ".hidden.txt").write_text("no")
    (tmp_path / "c.jsonl.gz").write_bytes(gzip.compress(b'{"body": "first"}\n\n{"body": "second"}\n"bare"\n'))
    (tmp_path / "d.json").write_text(json.dumps({"meta": 1, "rows": [{"text": "j1"}, {"text": "j2"}]}))
    (tmp_path / "e.csv").write_text('id,text\n1,"two\nlines"\n\n2,x,extra\n')
    (tmp_path / "f.docx").write_bytes(docx())
    db = sqlite3.connect(tmp_path / "g.db")
    db.execute("CREATE TABLE letters (nr INTEGER PRIMARY KEY, content TEXT)")
    db.executemany("INSERT INTO letters VALUES (?, ?)", [(2, "later"), (1, "sooner"), (3, None)])
    db.commit()
    db.close()
    with zipfile.ZipFile(tmp_path / "h.zip", "w") as z:
        z.writestr("in/z.txt", "zipped")
        z.writestr("in/y.jsonl.bz2", bz2.compress(b'{"text": "packed"}\n'))
        z.writestr("in/more.zip", b"")
        z.writestr("__MACOSX/x.txt", "no")
    (tmp_path / "strange.pdf").write_text("no")
    (tmp_path / "noext").write_text("no")
    return tmp_path


def texts(df):
    return [(r["source"], r["text"]) for r in df.orderBy("source_idx", "ordinal").collect()]


def test_all_formats_in_order(spark, corpus):
    d, counts, listing = readers.read(spark, str(corpus))
    assert texts(d) == [("_b.txt.xz", "größer"), ("a.txt", "alpha\rbeta\n"), ("c.jsonl.gz", "first"), ("c.jsonl.gz", "second"), ("c.jsonl.gz", "bare"), ("d.json", "j1"), ("d.json", "j2"), ("e.csv", "two\nlines"), ("e.csv", "x"), ("f.docx", "One\ttwo\nthree"), ("g.db", "sooner"), ("g.db", "later"), ("h.zip::in/y.jsonl.bz2", "packed"), ("h.zip::in/z.txt", "zipped")]
    got = {(r["source"], r["outcome"]): r["n"] for r in counts.collect()}
    assert got["e.csv", "extra_field_rows"] == 1 and got["g.db", "short_documents"] == 1
    assert listing.counts == {"unrecognized": 2, "nested_archive": 1}
    offsets = [r["byte_offset"] for r in d.where("source = 'c.jsonl.gz'").orderBy("ordinal").collect()]
    assert offsets == [0, 19, 38]


@pytest.mark.parametrize(("name", "data", "error"), [("a.txt", b"ok\xff", DatasetDecodeError), ("a.txt", b"a\0b", DatasetFormatError), ("a.txt.gz", gzip.compress(b"x" * 999)[:-9], DatasetError), ("a.jsonl", b'{"no": 1}', DatasetFormatError), ("a.json", b'{"a": [], "b": []}', DatasetFormatError), ("a.csv", b"a,b\n1,2\n", DatasetFormatError)])
def test_refusals(tmp_path, name, data, error):
    (tmp_path / name).write_bytes(data)
    source = readers.discover(str(tmp_path)).sources[0]
    with pytest.raises(error):
        readers._read(*source[:5], readers.Options(), {})


def test_skipping_counts(tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x"}\n{"text": 5}\nnope\n')
    (tmp_path / "b.txt").write_bytes(b"\xff")
    o = readers.Options(on_error="skip")
    a, b = (readers._read(*s[:5], o, {}) for s in readers.discover(str(tmp_path)).sources)
    assert a.counts == {"records_skipped": 2} and len(a.rows) == 1 and b.counts == {"files_skipped": 1} and not b.rows


def test_nothing_readable(tmp_path):
    with pytest.raises(DatasetError):
        readers.discover(str(tmp_path))
    with pytest.raises(DatasetError):
        readers.discover(str(tmp_path / "absent"))


def test_shards_hold_the_stream_and_notice_damage(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [("val" if i % 5 == 0 else "train", i, [int(x) for x in rng.integers(0, 500, rng.integers(0, 40))]) for i in range(60)]
    rows = [(s, i, ids, [j % 2 for j in range(len(ids))]) for s, i, ids in rows]
    df = spark.createDataFrame(rows, "split string, doc_id long, ids array<int>, mask array<int>").repartition(5)
    out = str(tmp_path / "set")
    m = shards.write(df, out, 500, shard_tokens=100)
    for side in ("train", "val"):
        want = [x for s, _, ids, _ in rows if s == side for x in ids]
        got = [x for r in shards.tokens(spark, out, side).orderBy("shard").collect() for x in r["ids"]]
        assert got == want and m["splits"][side]["tokens"] == len(want)
    assert shards.write(df.repartition(3), str(tmp_path / "again"), 500, shard_tokens=100)["content_hash"] == m["content_hash"]
    assert {r["state"] for r in shards.verify(spark, out).collect()} == {"ok"}
    path = f"{out}/train_00000.bin"
    data = bytearray(open(path, "rb").read())
    data[3] ^= 1
    open(path, "wb").write(data)
    assert {r["name"]: r["state"] for r in shards.verify(spark, out).collect()}["train_00000.bin"] == "wrong_hash"
    text = open(f"{out}/manifest.json").read()
    open(f"{out}/manifest.json", "w").write(text.replace('"vocab_size": 500', '"vocab_size": 501'))
    with pytest.raises(VerificationError):
        shards.load(out)


def test_failure_leaves_what_was_there(spark, tmp_path):
    out = tmp_path / "set"
    out.mkdir()
    (out / "keep").write_text("x")
    df = spark.createDataFrame([("val", 1, [1, 2])], "split string, doc_id long, ids array<int>")
    with pytest.raises(EmptySplitError):
        shards.write(df, str(out), 500, shard_tokens=100)
    assert [p.name for p in tmp_path.iterdir()] == ["set"] and (out / "keep").exists()


@pytest.mark.parametrize(("k", "name"), list(enumerate(readers.TEXT_COLUMNS)))
def test_columns_in_order_of_preference(k, name):
    later = readers.TEXT_COLUMNS[k:]
    assert readers.column(["id", *reversed(later), "title"], None, "a.csv") == len(later)
    assert readers.column(["id", f" {name.upper()} "], None, "a.csv") == 1


def test_columns_that_are_no_text():
    for header in (["id", "raw_content"], ["id", "description"], ["a;b"]):
        with pytest.raises(DatasetFormatError):
            readers.column(header, None, "a.csv")


def test_lines_and_rows_pass_through_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "FLUSH_ROWS", 7)
    lines = "".join(f'{{"text": "zeile {i} ü"}}\n' for i in range(50)).encode()
    (tmp_path / "a.jsonl").write_bytes(b"\xef\xbb\xbf" + lines)
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress("id,review_text,message\n".encode() + b"".join(f'{i},"row\n{i}",no\n'.encode() for i in range(50))))
    d, counters, _ = readers.read(spark, str(tmp_path))
    got = {k: [(r["ordinal"], r["text"]) for r in d.where(F.col("source") == k).orderBy("ordinal").collect()] for k in ("a.jsonl", "b.csv.gz")}
    assert got == {"a.jsonl": [(i, f"zeile {i} ü") for i in range(50)], "b.csv.gz": [(i, f"row\n{i}") for i in range(50)]}
    assert {r["source"]: r["n"] for r in counters.where("outcome = 'documents'").collect()} == {"a.jsonl": 50, "b.csv.gz": 50}


@pytest.mark.parametrize(("name", "good"), [("a.jsonl", b'{"text": "ok"}\n'), ("a.csv", b"text\nok\n")])
def test_places_of_undecodable_bytes_are_those_of_the_source(tmp_path, name, good):
    data = good * 3 + b'"\xff"\n'
    (tmp_path / name).write_bytes(data)
    source = readers.discover(str(tmp_path)).sources[0]
    with pytest.raises(DatasetDecodeError) as e:
        readers._read(*source[:5], readers.Options(), {})
    assert e.value.details["at"] == data.index(b"\xff")
    rows = readers._read(*source[:5], readers.Options(on_error="skip"), {})
    assert rows.counts == {"files_skipped": 1} and not rows.rows


TALKS = [[("user", "a b"), ("Assistant", "c"), ("user", "d"), ("assistant", "e"), ("assistant", "f")], [("system", "s"), ("user", "u"), ("assistant", "r")]]


def test_conversations_are_read_as_they_are_rendered(spark, tmp_path):
    good = [json.dumps({"messages": [{"role": r, "content": c} for r, c in t]}) for t in TALKS]
    bad = ['{"messages": "x"}', '{"messages": []}', '{"messages": [1]}', '{"messages": [{"content": "x"}]}', '{"messages": [{"role": "tool", "content": "x"}]}', '{"messages": [{"role": "user"}]}', '{"messages": [{"role": "user", "content": " "}]}', '{"messages": [{"role": "user", "content": "x"}]}', '{"text": "x"}', '"x"']
    (tmp_path / "a.jsonl").write_text("\n".join([good[0], *bad, good[1]]))
    d, counters, _ = readers.read(spark, str(tmp_path), readers.Options(messages_field="messages", on_error="skip"))
    got = [(r["ordinal"], r["text"], [tuple(x) for x in r["trained_spans"]]) for r in d.orderBy("ordinal").collect()]
    talks = spark.createDataFrame([(i, t) for i, t in enumerate(TALKS)], "i long, messages array<struct<role:string,content:string>>")
    want = [(r["i"], r["rendered"], [tuple(x) for x in r["spans"]]) for r in chat.render(talks).orderBy("i").collect()]
    assert got == want
    n = {r["outcome"]: r["n"] for r in counters.collect()}
    assert n["records_skipped"] == len(bad) and n["chat_documents"] == 2 and n["chat_trained_chars"] == sum(hi - lo for _, _, s in want for lo, hi in s)
    with pytest.raises(DatasetFormatError):
        readers._read(*readers.discover(str(tmp_path)).sources[0][:5], readers.Options(messages_field="messages"), {})
