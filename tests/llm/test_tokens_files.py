import hashlib
import zlib
from pathlib import Path

import numpy as np
import pytest

from ligneo.llm.common import shared_folder
from ligneo.llm.packing import cut_points, pack_documents, sequences
from ligneo.llm.tokenfile import EliasFano, Segment, read_tokens, write_tokens
from ligneo.llm.tokens import TextEncoder, default_tokenizer
from ligneo.llm.warc import Bundle, BundleWriter, parse_records, read_archive, record_id, warc_record, write_archive


def document_rows(make_prose):
    rows = [(7 * i % 101, make_prose(i, 1 + (i * i) % 700), "en", "s") for i in range(101)]
    return rows + [(500, None, None, None), (501, "", "en", "s"), (None, "without id", "en", "s"), (502, make_prose(9, 30_000), "en", "s"), rows[3], rows[3]]


@pytest.fixture(scope="module")
def ids_of():
    library = TextEncoder(default_tokenizer()).library
    return lambda text: [*library.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_pieces_cover_a_document():
    for length in (1, 5, 127, 128, 129, 511, 512, 1023, 1024, 1025, 5000):
        cuts = cut_points(length, 1024)
        assert sum(cuts) == length and len(cuts) <= length // 1024 + 4
    assert cut_points(10, 4) == [4, 4, 2] and cut_points(3, 4) == [2, 1]


def test_packing_places_every_token_once(documents, make_prose, ids_of):
    rows = document_rows(make_prose)
    pieces = pack_documents(documents(rows), keep_ids=True)
    got, bins = pieces.collect(), {}
    texts = {}
    for i, t, _, _ in rows:
        texts.setdefault(i, []).append(ids_of(t))
    for r in got:
        ids = texts[r.doc_id][0]
        assert r.doc_tokens == len(ids) and list(r.ids) == ids[r.start:r.start + r.length] and r.ids_crc32 == crc(r.ids)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(len(x) for found in texts.values() for x in found)
    padding = 0
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 1024 - at
    assert padding < 0.05 * 1024 * len(bins) + 1024
    assert sorted(bins) == list(range(len(bins)))
    whole = {r.sequence_id: r for r in sequences(pieces).collect()}
    assert all(len(r.ids) == r.filled == sum(n for _, n in bins[s]) for s, r in whole.items())


def test_elias_fano_selects_every_value():
    draw = np.random.default_rng(3)
    for count, limit in ((1, 1), (1, 10**6), (700, 700), (5000, 4_000_000), (300, 400)):
        values = np.sort(draw.integers(0, limit + 1, count))
        packed = EliasFano.encode(values, limit)
        assert packed.all().tolist() == values.tolist()
        assert [packed.select(i) for i in range(count)] == values.tolist()
        size = sum(p.nbytes for p in (packed.low, packed.high, packed.ranks))
        assert size == sum(EliasFano.sizes(count, limit)) and size * 8 <= count * (np.log2(limit / count + 1) + 4) + 64


def test_segment_round_trip():
    arrays = [np.arange(n, dtype="<u4") for n in (3, 1, 900, 2)]
    segment = Segment.from_bytes(Segment.build(4, 2, arrays, [5, None, -7, 2**60], 2).to_bytes())
    assert (segment.part, segment.number, segment.docs.tolist()) == (4, 2, [5, 0, -7, 2**60])
    assert [segment.document(i).tolist() for i in range(4)] == [a.tolist() for a in arrays]


def test_token_files_read_back(spark, documents, make_prose, ids_of):
    rows, folder = document_rows(make_prose), shared_folder(spark)
    manifest = write_tokens(documents(rows), folder, segment_ids=5000)
    assert manifest.count() > 5
    got = sorted(read_tokens(spark, folder, manifest).collect(), key=lambda r: r.start)
    expected = sorted(((i is not None, i or 0, len(ids_of(t)), crc(ids_of(t))) for i, t, _, _ in rows), key=lambda x: x[:2])
    assert [(r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got] == expected
    assert [r.start for r in got] == np.cumsum([0, *[e[2] for e in expected]])[:-1].tolist()


def test_token_operators_on_an_empty_table(spark, documents):
    folder = shared_folder(spark)
    assert pack_documents(documents([])).count() == 0
    assert read_tokens(spark, folder, write_tokens(documents([]), folder)).count() == 0


def page_rows(make_prose):
    long = make_prose(1, 60)
    rows = [(i, f"http://x/{i}", make_prose(i, 3 + i)) for i in range(60)]
    return rows + [(100, None, long), (99, "http://y\r\nX-Page-ID: 5", long), (99, "http://y", long), (None, "z", long), (102, "é ü", "short"), (101, "k", "short"),
                   (103, "n", None), (104, "n", ""), (105, "big", make_prose(3, 40_000)), (106, "u", "日本" * 40), (107, "u", "日本" * 40)]


def test_archive_reads_back(spark, make_prose):
    rows, folder = page_rows(make_prose), shared_folder(spark)
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, size int")
    got = read_archive(spark, folder, write_archive(pages, folder, frame_bytes=5000, bundle_bytes=20_000)).collect()
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    expected = []
    for i, _, h in rows:
        data, target = (h or "").encode(), first.get(h)
        revisit = target is not None and i != target
        expected.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", target if revisit else None))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    empty = pages.limit(0)
    folder = shared_folder(spark)
    assert read_archive(spark, folder, write_archive(empty, folder)).count() == 0


def test_bundle_gives_single_records_and_plain_frames():
    import zstandard

    writer, payloads = BundleWriter(frame_bytes=400), [b"p" * n for n in (0, 5, 900, 30)]
    for i, payload in enumerate(payloads):
        writer.add(record_id(i, "d"), warc_record(i, "http://u", payload, "d", len(payload), None, "2024-01-01T00:00:00Z"))
    content = writer.finish()
    bundle = Bundle(content)
    for i, payload in enumerate(payloads):
        headers, read = bundle.record(record_id(i, "d"))
        assert read == payload and headers[b"X-Page-ID"] == str(i).encode()
    with pytest.raises(KeyError):
        bundle.record(record_id(9, "d"))
    plain = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
    assert [p for _, p in parse_records(plain)] == payloads


def test_ids_beyond_two_bytes_are_kept(documents, tmp_path):
    """A vocabulary of 70,000 and an added token behind it: four bytes an id, read back whole."""
    import json

    from tokenizers import Tokenizer

    from ligneo.llm.tokenfile import id_width
    from ligneo.llm.tokens import default_tokenizer

    made = json.loads(Path(default_tokenizer()).read_text())
    made["model"]["vocab"].update({f"none{i}": i for i in range(len(made["model"]["vocab"]), 70_000)})
    path = str(tmp_path / "large.json")
    Path(path).write_text(json.dumps(made))
    library = Tokenizer.from_file(path)
    library.add_tokens(["<|far|>"])
    library.save(path)
    assert id_width(path) == 4 and id_width(default_tokenizer()) == 2 and id_width(default_tokenizer(), 70_000) == 4
    texts = {1: "plain words", 2: "one <|far|> away", 3: ""}
    docs = documents([(i, t, "en", "s") for i, t in texts.items()])
    folder = "file://" + str(tmp_path / "files")
    found = {r.doc_id: r for r in read_tokens(docs.sparkSession, folder, write_tokens(docs, folder, tokenizer=path)).collect()}
    for i, text in texts.items():
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [0], dtype="<u4")
        assert found[i].n_tokens == len(ids) and found[i].ids_crc32 == zlib.crc32(ids.tobytes())
    assert library.token_to_id("<|far|>") >= 70_000


def test_rows_without_an_id_are_spread_over_the_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    folder = "file://" + str(tmp_path / "files")
    parts = [r["documents"] for r in write_tokens(docs, folder).groupBy("part").agg(F.sum("documents").alias("documents")).collect()]
    assert sum(parts) == 20_000 and len(parts) >= 3 and max(parts) < 12_000
