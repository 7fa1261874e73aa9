"""Streams and records against readers of other make; awkward rows of the operators that read or write them."""

import base64
import hashlib
import random
import struct
from email.parser import BytesHeaderParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import bwt_dedup, html_lstm, mixing, mpegts, pii, queries, warc
from tests.llm.test_operators import DOC, documents


def demultiplexed(media):
    """A plain reader, packet by packet: payload and (pts, random access) of the elementary packets of the first programme's first stream."""
    pmt = stream = None
    counters, units, flagged = {}, [], False
    for at in range(0, len(media), 188):
        packet = media[at : at + 188]
        head = struct.unpack(">I", packet[:4])[0]
        assert head >> 24 == 0x47
        begins, pid, adaptation, counter = head >> 22 & 1, head >> 8 & 0x1FFF, head >> 4 & 3, head & 15
        assert pid not in counters or counter == (counters[pid] + 1) % 16
        counters[pid] = counter
        body, random_access = packet[4:], False
        if adaptation & 2:
            random_access = bool(body[0] and body[1] & 0x40)
            body = body[1 + body[0] :]
        if pid == 0:
            section = body[1 + body[0] :]
            pmt = struct.unpack(">H", section[10:12])[0] & 0x1FFF
        elif pid == pmt:
            section = body[1 + body[0] :]
            skip = struct.unpack(">H", section[10:12])[0] & 0xFFF
            stream = struct.unpack(">H", section[13 + skip : 15 + skip])[0] & 0x1FFF
        elif pid == stream:
            if begins:
                assert body[:3] == b"\0\0\1"
                b = body[9:14]
                pts = (b[0] >> 1 & 7) << 30 | (b[1] << 7 | b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1
                units.append([body[9 + body[8] :], pts, random_access, struct.unpack(">H", body[4:6])[0] - 3 - body[8]])
            else:
                units[-1][0] += body
    assert all(len(u[0]) == u[3] for u in units)
    return b"".join(u[0] for u in units), [(u[1], u[2]) for u in units]


@pytest.mark.parametrize("size", [1, 5000, 9216, 100_000, 1_000_000])
def test_streams_read_by_a_plain_reader(size):
    payload = mpegts.pad_payload("".join(random.Random(size).choices("ab é\n", k=size)))
    media = mpegts.write_stream(payload)
    found, units = demultiplexed(media)
    read = mpegts.read_stream(media)
    assert found == payload == read["payload"]
    assert units == [(u["pts"], u["random_access"]) for u in read["units"]]


def test_stream_query_values_and_awkward_rows(spark, tmp_path):
    texts = ["same text", "same text", None, "", "y" * 40_000]
    docs = documents(spark, texts, extra=True).withColumn("media", F.lit("clash")).withColumn("read", F.lit(1))
    made = mpegts.read_streams(mpegts.write_streams(docs)).collect()
    assert [bytes(r.read.payload) for r in sorted(made, key=lambda r: r.doc_id)] == [mpegts.pad_payload(t) for t in texts] and made[0].fp == "clash"
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op3_mpeg_transport_streams(spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        media = mpegts.write_stream(mpegts.pad_payload(t))
        payload, units = demultiplexed(media)
        assert (got[k].media_bytes, got[k].media_sha256, got[k].payload_bytes) == (len(media), hashlib.sha256(media).hexdigest(), len(payload))
        assert got[k].feature == f"packets={len(media) // 188};units={len(units)};random_access={sum(r for _, r in units)};pts={units[0][0]}-{units[-1][0]};errors=0"
    assert mpegts.read_streams(mpegts.write_streams(docs.limit(0))).count() == 0


def warc_record(raw):
    """Header and block of a record by the standard library's parser."""
    line, _, rest = raw.partition(b"\r\n")
    assert line == b"WARC/1.1"
    head, _, body = rest.partition(b"\r\n\r\n")
    fields = BytesHeaderParser().parsebytes(head + b"\r\n")
    size = int(fields["Content-Length"])
    assert body[size:] == b"\r\n\r\n"
    return fields, body[:size]


def test_records_read_by_another_parser(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages = pages.unionByName(pages.limit(1)).unionByName(spark.createDataFrame([(10**6, "http://long/", "<p>word " * 50_000), (10**6 + 1, None, None)], "page_id long, url string, html string"))
    clash = pages.withColumn("record_type", F.lit("clash")).withColumn("valid", F.lit(7)).withColumn("kept", F.lit("own"))
    made = warc.derive(warc.write_responses(clash.withColumn("record", F.lit(1)))).collect()
    sources = {(r.page_id, r.url): r for r in pages.collect()}
    assert len(made) == 2 * pages.count() and all(r.kept == "own" and r.valid is True for r in made)
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    for r in made:
        fields, block = warc_record(bytes(r.record))
        page = (sources[r.page_id, r.url].html or "").encode()
        assert fields["WARC-Type"] == r.record_type and fields["WARC-Refers-To"] == r.refers_to and fields["WARC-Record-ID"] == r.record_id != r.refers_to
        assert fields["WARC-Block-Digest"] == sha(block) and fields["WARC-Source-Payload-Digest"] == sha(page) == r.source_payload_digest
        if r.record_type == "metadata":
            about = BytesHeaderParser().parsebytes(block)
            assert about["source-status"] == "HTTP/1.1 200 OK" and about["source-content-length"] == str(len(page))
    text = {r.page_id: bytes(r.block).decode() for r in made if r.record_type == "conversion"}
    assert text[10**6] == "\n".join(["word"] * 50_000) and text[10**6 + 1] == ""


def test_pages_empty_repeated_and_long(spark):
    weights = {k: v for k, v in html_lstm.fit_texts([["some words of a page, long enough to be used."]], 40, 1).items()}
    rows = [(1, "<article><p>one</p></article>"), (1, "<article><p>one</p></article>"), (2, "<p>x</p>" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    got = html_lstm.extract(pages, weights).collect()
    assert len(got) == 3 and got[0].text == got[1].text
    assert html_lstm.extract(pages.limit(0), weights).count() == 0


def test_mixing_without_ids(spark):
    rows = [(None, "w " * (1 + k % 5), "en", "src1", 1) for k in range(200)]
    plan = mixing.mix_plan(spark.createDataFrame(rows, DOC), F.expr("tokens * 2"), max_epochs=3).collect()
    assert len(plan) == 200 and {r.copies for r in plan} == {2}  # all have one key, and so go together


def test_fragments_by_stretches(spark, monkeypatch):
    rng = random.Random(20)
    word = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    shared = word(2500)
    texts = [word(700) + shared + word(900), shared[300:2200] + word(50), word(3000), "ab" * 2000]
    monkeypatch.setattr(bwt_dedup, "CHUNK", 611)
    cut = [bwt_dedup.fragments(t.encode()) for t in texts]
    monkeypatch.setattr(bwt_dedup, "CHUNK", 1 << 20)
    whole = [bwt_dedup.fragments(t.encode()) for t in texts]
    for a, b in zip(cut, whole):
        name = lambda rows: np.concatenate([np.full(r["e"] - r["s"], r["h"]) for r in rows])
        assert len(a) > len(b) and (name(a) == name(b)).all()


def test_planted_identifiers_are_found(spark):
    """Identifiers of shapes that no base kind has, in contexts that base spans have too: recall and precision over all tokens."""
    rng = random.Random(21)
    frames = ["please write to {} at once", "your contact is {} for this", "send it via {} by noon", "signed by {} on behalf of"]
    pads = ["the report ran late", "no one was there", "all went well in spring", "prices rose again"]
    email = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(10**4)}@x{rng.randrange(99)}.org"
    shapes = [lambda: f"EMP-{rng.randrange(10**5):05d}-Q", lambda: f"user{rng.randrange(10**6)}", lambda: f"{rng.randrange(10**4)}.{rng.choice('KLM')}{rng.randrange(10**4)}", lambda: f"P{rng.randrange(10**8):08d}"]
    noise = ["order {} was shipped", "version {} came out", "see page {} there", "room {} is closed"]
    texts, planted = [], set()
    for k in range(400):
        part = rng.choice(pads) + " and "
        if k % 4 < 2:
            texts.append(part + rng.choice(frames).format(email()))
        elif k % 4 == 2:
            token, frame = rng.choice(shapes)(), rng.choice(frames)
            texts.append(part + frame.format(token))
            planted.add((k, texts[-1].index(token), texts[-1].index(token) + len(token)))
        else:
            texts.append(part + rng.choice(noise).format(rng.choice(shapes)()))
    found = set()
    for r in pii.digest(documents(spark, texts)).collect():
        for s in filter(lambda x: x.startswith("id:"), r.spans.split(",")):
            found.add((r.doc_id, *map(int, s.split(":")[1:])))
    assert len(planted & found) >= 0.9 * len(planted) and len(planted & found) >= 0.95 * len(found)


def test_repeated_headers_all_stay():
    from foliospark.llm import warc

    payload = b"<title>t</title>hi"
    block = b"HTTP/1.1 200 OK\r\ncontent-type: text/html\r\nSet-Cookie: a=1\r\nX: folded\r\n  line\r\nset-cookie: b=2\r\nSet-Cookie: a=1\r\n\r\n" + payload
    raw = warc.write_record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Payload-Digest", warc.digest(payload)), ("WARC-Block-Digest", warc.digest(block))], block)
    meta, plain = warc.derivatives(raw)
    for made in (meta, plain):
        assert made["valid"] and dict(made["source_headers"]) == {"content-type": ["text/html"], "Set-Cookie": ["a=1", "b=2", "a=1"], "X": ["folded line"]}
    names = [line.split(b": ")[0] for line in meta["block"].split(b"\r\n") if line]
    assert names == [b"source-status", b"source-content-type", b"source-set-cookie", b"source-x", b"source-set-cookie", b"source-set-cookie", b"title", b"links"]


def test_copies_without_id_are_indexed_once(spark):
    from pyspark.sql import functions as F

    from foliospark.llm import bwt_dedup

    text = " ".join(f"word{k * k}" for k in range(60))
    docs = spark.createDataFrame([(None, text)] * 400 + [(1, "other " * 100)], "doc_id long, text string")
    keyed = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.unhex(F.md5("text")).alias("_key"), F.col("text").cast("binary").alias("_text"))
    wanted = keyed.filter("_id = -1").select("_key", "_id").distinct().withColumn("_list", F.array(F.struct(*[F.lit(1).cast("long").alias(c) for c in ("h", "f1", "f2")], F.lit(True).alias("many"), F.lit(False).alias("hot"), F.lit(0).alias("s"), F.lit(1).alias("e"))))
    assert bwt_dedup._pieces(keyed.repartition("_key"), F.broadcast(wanted)).count() == 1
    got = bwt_dedup.repeated_passages(docs).select("doc_id", "n_bytes", "n_removed").distinct().collect()
    assert {(r.doc_id, r.n_removed) for r in got} == {(None, len(text)), (1, 600)}
