"""The registered corpus queries on the smallest tables, against their SQL where there is one; the pipeline stage by stage against plain versions."""

import glob
import zlib
from array import array
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import langid, mixing, queries

from .test_operators import TOKENIZER, WORD, alike, brute_components, shingle_set

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {p.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{p}'")
    got, want = queries.queries()[name](spark, SF).toPandas(), db.sql(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(df[columns].astype(str).itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in c.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "source_mix", "packing"]
    out = c.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kept = c.language(spark, docs, SF)
    assert kept.columns == c.COLUMNS and kept.count() > 0.95 * docs.count()
    ends = out.groupBy("sequence_id").agg({"length": "sum"}).orderBy("sequence_id").collect()
    assert all(r[1] == 2048 for r in ends[:-1])


def plain_lines(rows, sites=8):
    """doc_id: text, where a line on at least ``sites`` sources stays only where it stands first."""
    on, first = defaultdict(set), {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        for i, x in enumerate((r.text or "").split("\n")):
            on[x.strip(" \t\r")] |= {r.source} - {None}
            first.setdefault(x.strip(" \t\r"), (r.doc_id, i))
    gone = {x for x, s in on.items() if x and len(s) >= sites}
    kept = lambda r: "\n".join(x for i, x in enumerate(r.text.split("\n")) if (k := x.strip(" \t\r")) not in gone or first[k] == (r.doc_id, i))
    return {r.doc_id: kept(r) if r.text is not None else None for r in rows}


def test_pipeline_stages_are_their_plain_versions(spark, tmp_path, monkeypatch):
    """Each written stage against a plain version that is given the stage before it; the chain as a whole loses and adds nothing else."""
    import corpus_pipeline as c

    given = spark.read.parquet(f"{SF}/documents.parquet")
    long = given.filter("n_chars > 600").orderBy("doc_id").limit(30)
    footed = long.select((F.col("doc_id") + 100_000).alias("doc_id"), F.concat("text", F.lit("\nA footer that stands on every site")).alias("text"), "lang", F.concat(F.lit("site"), F.col("doc_id") % 9).alias("source"), "n_chars")
    near = long.select((F.col("doc_id") + 200_000).alias("doc_id"), F.concat("text", F.lit(" end")).alias("text"), "lang", F.lit(None).cast("string").alias("source"), "n_chars")
    odd = spark.createDataFrame([(300_000, None, "en", "s", 0), (300_001, "", None, None, 0), (300_002, "12 34 \n\n 56", "de", "s", 11)], given.schema)
    given.unionAll(footed).unionAll(near).unionAll(odd).write.parquet(str(tmp_path / "documents.parquet"))
    paths = {}
    monkeypatch.setattr(c, "scratch_path", lambda spark, name: paths.setdefault(name.removeprefix("stage-"), str(tmp_path / name)))
    out = c.run(spark, str(tmp_path)).collect()
    tables = {"": spark.read.parquet(str(tmp_path / "documents.parquet"))} | {n: spark.read.parquet(paths[n]) for n, _ in c.STAGES}
    rows = {n: t.collect() for n, t in tables.items()}

    verdict = {r.doc_id: r for r in langid.predict(tables[""], langid.fit(tables[""])).collect()}
    want = [(r.doc_id, r.text, verdict[r.doc_id].lang_pred, r.source, r.n_chars) for r in rows[""] if not verdict[r.doc_id].rejected]
    assert Counter(map(tuple, rows["language_id"])) == Counter(want) and len(want) < len(rows[""])
    assert not {300_000, 300_001, 300_002} & {r.doc_id for r in rows["language_id"]}

    cut = plain_lines(rows["language_id"])
    assert {r.doc_id: r.text for r in rows["line_dedup"]} == cut and len(rows["line_dedup"]) == len(rows["language_id"])
    assert any(cut[r.doc_id] != r.text for r in rows["language_id"]) and all(r.n_chars == len(r.text) for r in rows["line_dedup"])

    sets = {r.doc_id: shingle_set(r.text) for r in rows["line_dedup"]}
    root = brute_components(sorted(sets.items()), alike)
    assert {tuple(r) for r in rows["simhash_dedup"]} == {tuple(r) for r in rows["line_dedup"] if root[r.doc_id] == r.doc_id}
    assert len(rows["simhash_dedup"]) == len(set(root.values())) <= len(sets) - 30

    taken = {r.doc_id: r for r in mixing.taken(mixing.mix(tables["simhash_dedup"], block=128)).collect()}
    words, texts = Counter(), {r.doc_id: WORD.findall(r.text) for r in rows["simhash_dedup"]}
    for r in rows["source_mix"]:
        mine = iter(texts[r.doc_id])
        assert all(w in mine for w in WORD.findall(r.text))  # words of the document, in its order
        words[r.doc_id] += len(WORD.findall(r.text))
    assert set(texts) == set(taken) and all(words[i] == t.taken <= 3 * t.size and t.size == len(texts[i]) for i, t in taken.items())
    by_source = defaultdict(int)
    for r in rows["simhash_dedup"]:
        by_source[r.source] += words[r.doc_id]
    assert all(abs(by_source[r.source] - taken[r.doc_id].target) <= 256 for r in rows["simhash_dedup"])

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    ids = defaultdict(list)
    for r in rows["source_mix"]:
        ids[r.doc_id].append([*tokenizer.encode(r.text, add_special_tokens=False).ids, 1])
    assert sum(r.length for r in out) == sum(len(x) for v in ids.values() for x in v)
    # every piece is cut from a pass of its document, and every place of every pass is in one piece
    digest = lambda x: zlib.crc32(array("I", x).tobytes())
    assert all(any(len(x) == r.doc_tokens and digest(x[r.start : r.start + r.length]) == r.ids_crc32 for x in ids[r.doc_id]) for r in out)
    covered = Counter((r.doc_id, r.doc_tokens, i) for r in out for i in range(r.start, r.start + r.length))
    assert covered == Counter((d, len(x), i) for d, v in ids.items() for x in v for i in range(len(x)))
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s, pieces in sequences.items():
        ends = [0, *(a + n for a, n in sorted(pieces))]
        assert [a for a, _ in sorted(pieces)] == ends[:-1] and (ends[-1] == 2048 or s == max(sequences))


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline as c

    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    out = c.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() == 0
