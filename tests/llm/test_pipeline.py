"""The pipeline's stages against what they promise, on the smallest tables."""

import re
import zlib

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from canopy.llm import pii, rules, tokens

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id: r for r in docs.collect()})
    start = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", v) for k, v in start.items()}

    def repeats(w):
        seen = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        return len({j for i, x in enumerate(seen) if seen.count(x) > 1 for j in (i, i + 1, i + 2)})

    passed = {k for k, w in words.items() if len(w) >= 50 and 100 * repeats(w) <= 50 * len(w)}
    assert set(kept[0]) == passed  # no boilerplate empties a document here
    assert set(kept[1]) <= set(kept[0]) and len({kept[1][k].text for k in kept[1]}) == len(kept[1])
    windows = set()
    for k in sorted(kept[1]):
        data = kept[1][k].text.encode()
        own = [data[a : a + 100] for a in range(len(data) - 99)]
        if k in kept[2] and len(kept[2][k].text) == len(kept[1][k].text):
            assert not windows.intersection(own) and len(set(own)) == len(own)
        windows.update(own)
    assert not any("@mail" in r.text for r in kept[3].values())
    assert set(kept[4]) == set(kept[3])


def test_awkward_rows(spark):
    rows = [(1, "t one two three four five six", "a"), (1, "t one two three four five six", "b"), (2, "T one two three four five six", "a"), (None, "t one two three four five six", "a"), (1, "quite another text of more than five words", "a")]
    rows += [(3, None, "a"), (3, "", "a"), (4, " ", None), (4, " ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `my col` string").withColumn("row", F.lit("mine")).withColumn("__id", F.lit(7))
    kept = corpus_pipeline.near_duplicates(spark, docs, DATA)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, rows[0][1]), (1, rows[4][1]), (3, None), (3, ""), (4, " "), (4, " ")], key=str)
    cut = corpus_pipeline.repeated_passages(spark, docs, DATA)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert {r["my col"] for r in cut.collect()} == {"a", "b", None}


def brute_rules(rows):
    """Texts by id after the rules: what fails goes, and lines of a twentieth, and twenty, of a source's different texts."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    normal = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.translate({**{c: c + 32 for c in range(65, 91)}, **{c: 48 for c in range(49, 58)}})).strip(" ")
    texts_of, lines_of = {}, {}
    for r in rows:
        text = r.text or ""
        texts_of.setdefault(r.source, set()).add(text)
        for x in {normal(x) for x in text.split("\n") if word.search(x)}:
            lines_of.setdefault((r.source, x), set()).add(text)
    common = {k for k, v in lines_of.items() if len(v) >= 20 and len(v) >= rules.SHARE * len(texts_of[k[0]])}
    out = {}
    for r in rows:
        text = r.text or ""
        w = word.findall(text)
        seen = {}
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        repeats = len({j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)})
        lines = [x for x in text.split("\n") if word.search(x)]
        boiler = sum(len(word.findall(x)) for x in lines if (r.source, normal(x)) in common)
        if len(w) >= 50 and 100 * repeats <= 50 * len(w) and boiler <= 0.75 * len(w):
            out[r.doc_id] = "\n".join(x for x in text.split("\n") if (r.source, normal(x)) not in common or not word.search(x))
    return out


def brute_near(texts):
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    root = {k: k for k in texts}
    find = lambda k: k if root[k] == k else find(root[k])
    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: t for k, t in texts.items() if find(k) == k}


def brute_passages(texts):
    seen, out = set(), {}
    for k in sorted(texts):
        data = texts[k].encode()
        gone = bytearray(len(data))
        for a in range(len(data) - 99):
            if data[a : a + 100] in seen:
                gone[a : a + 100] = b"\1" * 100
            seen.add(data[a : a + 100])
        if not all(gone):
            out[k] = bytes(c for c, x in zip(data, gone, strict=True) if not x).decode("utf-8", "ignore")
    return out


def test_run_against_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    texts = {k: pii.masked(t) for k, t in brute_passages(brute_near(brute_rules(rows))).items()}
    enc = tokens.from_json(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for p in corpus_pipeline.run(spark, DATA).collect():
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert by_doc.keys() == texts.keys()
    for k, t in texts.items():
        ids = [*enc.encode(t, add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(by_doc[k], key=lambda p: p.start):
            raw = b"".join(i.to_bytes(4, "little") for i in ids[at : at + p.length])
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(raw)), k
            at += p.length
        assert at == len(ids)
    for ps in by_sequence.values():
        ends = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == ends
            ends += p.length
        assert ends <= 2048
    # little padding: no more than a pack of the fullest fill would leave, and one part-filled sequence
    total = sum(p.length for ps in by_doc.values() for p in ps)
    assert len(by_sequence) <= total / 2048 * 1.05 + 1
