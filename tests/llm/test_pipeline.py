"""Each stage against a brute-force version, on a small corpus with nulls, copies, near
copies, boilerplate, shared passages, ties and an empty table."""

from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from bibmill.llm import minhash_dedup, quality_classifier

from test_operators import repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RNG = np.random.default_rng(11)
GOOD, BAD = ([f"{kind}{k}" for k in range(300)] for kind in ("word", "junk"))


def prose(n, words=GOOD):
    return "\n".join(" ".join(RNG.choice(words, 12)) for _ in range(n))


def corpus():
    shared = " ".join(RNG.choice(GOOD, 70))
    texts = [f"menu line\n{prose(6)}" for _ in range(24)] + [prose(5, BAD) for _ in range(10)]
    texts += [texts[0]] * 5 + [texts[1].replace(texts[1].split()[40], "other", 1)] + [f"{prose(3)}\n{shared}\n{prose(2)}", f"{prose(2)} {shared}", None, "", "  ", "�" + prose(1), "x" * 500, prose(900)]
    return [(i, t, "en", f"s{i % 2}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The corpus with labels, and what each stage made of what the last one kept."""
    top = f"{tmp_path_factory.mktemp('pipeline')}"
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, int("junk" not in (t or "")), 0) for i, t, *_ in rows if t], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    docs, out = spark.read.parquet(f"{top}/documents.parquet"), {"documents": rows}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, top).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        assert name == "packing" or docs.columns == corpus_pipeline.COLUMNS
        out[name] = sorted(map(tuple, docs.collect()))
    return out


def test_quality(tables):
    """The model's own score of each text decides; junk goes and prose stays."""
    rows = tables["documents"]
    taught = [(t, int("junk" not in t)) for i, t, *_ in rows if t and quality_test(i)]
    model = quality_classifier.train([quality_classifier.bag(t) for t, _ in taught], [y for _, y in taught])
    assert tables["quality"] == [r for r in rows if model.score([r[1] or ""])[0] >= 0.5]
    kept = {r[0] for r in tables["quality"]}
    assert all((i in kept) == ("junk" not in t) for i, t, *_ in rows if t and len(t) > 100)


def quality_test(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 3 != 1


def test_lines(tables):
    pages = defaultdict(set)
    split = lambda t: tuple(dict.fromkeys(x.strip(" ") for x in t.split("\n") if x.strip(" ")))
    for _, t, _, s, _ in tables["quality"]:
        pages[s or ""].add(None if t is None else split(t))
    want = []
    for i, t, lang, s, _ in tables["quality"]:
        held = Counter(x for p in pages[s or ""] if p for x in p)
        gone = {x for x, n in held.items() if n >= 2 and n > 0.05 * len(pages[s or ""])}
        text = None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" ") not in gone)
        want.append((i, text, lang, s, len(text or "")))
    assert tables["lines"] == want and any("menu" in (t or "") for _, t, *_ in tables["quality"]) and not any("menu" in (t or "") for _, t, *_ in want)


def test_near_copies(tables):
    rows = tables["lines"]
    words = [minhash_dedup.WORDS.findall((t or "").lower()) for _, t, *_ in rows]
    sets = [Counter(tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter() for w in words]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            c = (sets[a] & sets[b]).total()
            if (rows[a][1] or "") == (rows[b][1] or "") or c and c >= 0.8 * (sets[a].total() + sets[b].total() - c):
                root = [root[b] if r == root[a] else r for r in root]
    kept = {r[0]: r for r in tables["near_copies"]}
    classes = defaultdict(list)
    for row, r in zip(rows, root):
        classes[r].append(row)
    assert all(sum(x[0] in kept for x in members) == 1 for members in classes.values())
    assert all(r in rows for r in kept.values()) and len(kept) == len(classes) < len(rows)


def test_passages(tables):
    rows = tables["near_copies"]
    want = []
    for (i, t, lang, s, _), (_, _, _, kept) in zip(rows, repeats([r[1] for r in rows])):
        want.append((i, kept.decode(), lang, s, len(kept.decode())))
    assert tables["passages"] == want and any("�" in r[1] for r in want) and sum(r[4] for r in want) < sum(r[4] for r in rows)


def test_packing(tables):
    from tokenizers import Tokenizer

    from bibmill.llm.queries import WORD_BPE

    encode = Tokenizer.from_file(WORD_BPE).encode
    sizes = {i: len(encode(t or "", add_special_tokens=False).ids) + 1 for i, t, *_ in tables["passages"]}
    pieces, held = Counter(), Counter()
    for doc, _, _, length, _, seq, _ in tables["packing"]:
        pieces[doc] += length
        held[seq] += length
    assert pieces == sizes and max(held.values()) <= 4096 and len(held) == -(-sum(sizes.values()) // 4096)


def test_empty_table(spark, tables, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_copies_keep_their_text(spark):
    """A group of copies larger than a tenth of its source: lines takes only the
    menu, and near_copies keeps one whole body of each group."""
    bodies = ["\n".join(f"{who} body line {i} of its own text {i * 7}" for i in range(12)) for who in ("first", "second")]
    own = ["\n".join(f"page {k} line {i} says {k * i + k}" for i in range(12)) for k in range(20)]
    texts = [bodies[0]] * 20 + [bodies[1]] * 10 + own
    docs = spark.createDataFrame([(i, "menu\n" + t, "en", "s", len(t) + 5) for i, t in enumerate(texts)], SCHEMA)
    base = spark.conf.get("spark.checkpoint.dir")
    for k, stage in enumerate((corpus_pipeline.lines, corpus_pipeline.near_copies)):
        stage(spark, docs, None).write.mode("overwrite").parquet(f"{base}/copies-{k}")
        docs = spark.read.parquet(f"{base}/copies-{k}")
        if not k:
            assert sorted(r["text"] for r in docs.collect()) == sorted(texts)
    assert sorted(r["text"] for r in docs.collect()) == sorted(bodies + own)
