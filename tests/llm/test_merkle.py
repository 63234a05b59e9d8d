"""Merkle manifests against plain trees."""

import hashlib
import zlib

from pyspark.sql import functions as F

from cuelog.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves, arity=3):
    """Root and, for every leaf, its siblings and their sides."""
    level, at, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for k, p in enumerate(at):
            low = p // arity * arity
            paths[k].append(("".join(level[low:p]), "".join(level[p + 1:low + arity])))
            at[k] = p // arity
        level = [sha("".join(level[i:i + arity])) for i in range(0, len(level), arity)]
    return level[0], paths


def brute(rows, text, arity=3):
    """(doc_id, leaf, subroot, root, proof, folded) of rows (doc_id, source, lang, n_chars, text); ``text`` tampers."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], leaf(*r), leaf(*r[:4], text(r))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        groups[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    made = {name: tree([x[1] for x in groups[name]], arity) for name in names}
    root, over = tree([made[name][0] for name in names], arity) if names else (None, [])
    out = []
    for name, above in zip(names, over):
        for (doc, digest, changed), path in zip(groups[name], made[name][1]):
            way, node = path + above, changed
            for before, after in way:
                node = sha(before + node + after)
            out.append((doc, digest, made[name][0], root, sha("".join(b + a for b, a in way)), node))
    return sorted(out, key=str)


def _run(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, path string, digest int")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, merkle.leaf_of(*fields, F.translate("text", "\n", "")))
    made = merkle.manifest(docs, merkle.leaf_of(*fields, F.col("text")), tampered=tampered, **more)
    got = made.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256), merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return sorted((tuple(r) for r in got.collect()), key=str)


def _changed(r):
    even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
    return r[4].replace("\n", "") if even and r[4] is not None else r[4]


ODD = ([(k, "big", "en", 3, f"a\n{k}") for k in range(101)] + [(k, None, None, None, None) for k in range(4)] + [(None, "q", "en", 0, "")] * 2
       + [(7, "é", "", 5, "é\né")] * 3 + [(7, "é", "", 5, "other"), (1, "", "x", 1, "\n\n"), (1, "alone", "x", 1, "a\nb")])


def test_odd_rows(spark):
    assert _run(spark, ODD) == brute(ODD, _changed)


def test_many_storeys(spark):
    assert _run(spark, ODD, height=1) == brute(ODD, _changed)
    assert _run(spark, ODD, arity=2, height=2) == brute(ODD, _changed, 2)


def test_every_size(spark):
    rows = [(k, f"s{n}", "en", n, "x\ny") for n in range(1, 31) for k in range(n)]
    assert _run(spark, rows, height=2) == brute(rows, _changed)


def test_empty_and_single(spark):
    assert _run(spark, []) == []
    one = [(5, "s", "en", 1, "t")]
    assert _run(spark, one) == [(5, leaf(*one[0]), leaf(*one[0]), leaf(*one[0]), sha(""), leaf(*one[0]))]
