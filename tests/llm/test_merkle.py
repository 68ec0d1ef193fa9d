import hashlib
import re
import zlib

from pyspark.sql import functions as F

from wattline.llm import merkle, queries


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(hashes, arity):
    """Root, and for every leaf the siblings (left, right) from the lowest level up."""
    ways, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for way, k in zip(ways, at):
            first = k - k % arity
            way.append(("".join(hashes[first:k]), "".join(hashes[k + 1 : first + arity])))
        hashes = [h("".join(hashes[k : k + arity])) for k in range(0, len(hashes), arity)]
        at = [k // arity for k in at]
    return hashes[0], ways


def plain(rows, arity=3):
    """Sorted result rows, read from the contract; rows are (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        groups[name].sort(key=lambda x: x[:3])
    roots, below = [], {}
    for name in names:
        root, below[name] = climb([x[2] for x in groups[name]], arity)
        roots.append(root)
    root, above = climb(roots, arity)
    out = []
    for name, subroot, rest in zip(names, roots, above):
        for (_, _, own, row), way in zip(groups[name], below[name]):
            drawn = zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 2 == 0
            now = leaf((*row[:4], row[4] and row[4].replace("\n", ""))) if drawn else own
            for left, right in way + rest:
                now = h(left + now + right)
            proof = h("".join(a + b for a, b in way + rest))
            out.append((row[0], own, subroot, root, proof, now, now == root))
    return sorted(out, key=repr)


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def built(df, arity=3):
    """The rows of the query over any table, and the manifest."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    keep = {"doc_id": F.col("doc_id"), "tampered": F.when(
        F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0,
        merkle.leaf(*fields, F.translate("text", "\n", "")))}
    made = merkle.manifest(df, merkle.leaf(*fields, F.col("text")), "source", ["doc_id"], keep, arity)
    out = []
    refolded = merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    for r in made.proofs().select("*", refolded.alias("refolded"), merkle.path_digest(F.col("path")).alias("proof")).collect():
        digests = [bytes(r[c]).hex() for c in ("leaf", "subroot", "root", "proof", "refolded")]
        out.append((r["doc_id"], *digests, r["refolded"] == r["root"]))
    return sorted(out, key=repr), made


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, hash string, tree int, idx int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA)


def test_odd_rows(spark):
    rows = [(k, "hot", "en", k, f"text {k}\n" * (k % 3)) for k in range(100)]
    rows += [(1000 + k, f"s{k}", None, None, None if k % 2 else "") for k in range(11)]
    rows += [(None, None, None, None, None), (7, None, "", 0, "é\n\U0001f600"), (8, "", "de", 1, "x"), (9, "é", "de", 1, "long\n" * 100_000)]
    rows += [(5, "hot", "en", 5, "other text 5")] + [(77, "hot", "en", 1, "same\n")] * 9 + [(2000 + k, "four", "en", 1, "x\n") for k in range(4)]
    for arity in (2, 3, 5):
        got, made = built(frame(spark, rows), arity)
        assert got == plain(rows, arity)
    assert {r["tree"] for r in made.subroots().collect()} == {"" if r[1] is None else "=" + r[1] for r in rows}


def test_few_rows(spark):
    for rows in ([(3, "a", "x", 1, "t\n")], [(3, "a", "x", 1, "t"), (4, None, "x", 1, "u\n")]):
        assert built(frame(spark, rows))[0] == plain(rows)
    got, made = built(frame(spark, []))
    assert got == [] and made.root is None and made.subroots().count() == 0


def test_query_over_the_table(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    rows = [tuple(r) for r in table]
    out = queries.QUERIES["op13_merkle_manifest"](spark, sf).collect()
    assert sorted((tuple(r[c] for c in NAMES) for r in out), key=repr) == plain(rows)


def test_joins_are_equijoins_on_indices(spark):
    """No cross join, no window over a whole group: nodes meet by computed indices."""
    nodes = spark.createDataFrame([("=a", k, 4, bytes([k] * 32)) for k in range(4)], "tree string, idx long, n long, hash binary")
    for arity, right in ((2, ["01", "", "03", ""]), (3, ["0102", "02", "", ""])):
        met = merkle.with_siblings(nodes, arity)
        plan = met._jdf.queryExecution().toString()
        assert not re.search("Cartesian|NestedLoop|Window", plan)
        got = {r["idx"]: bytes(r["right"]).hex() for r in met.collect()}
        assert [got[k] for k in range(4)] == ["".join(x * 32 for x in re.findall("..", text)) for text in right]


def test_a_plan_holds_few_levels(spark):
    """Proofs over ten levels are as small a plan as over five: the driver keeps the whole of it."""
    sizes = []
    for rows in (2**4 + 1, 2**9 + 1):
        df = spark.range(rows).select(F.lit("a").alias("source"), F.col("id").alias("doc_id"))
        made = merkle.manifest(df, merkle.leaf(F.col("doc_id")), "source", ["doc_id"], {"doc_id": F.col("doc_id")}, 2)
        sizes.append(len(re.findall(r"\bJoin\b", made.proofs()._jdf.queryExecution().optimizedPlan().toString())))
    assert sizes[0] == sizes[1] <= 2 * merkle.PLAN_LEVELS
