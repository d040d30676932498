"""Secret scan with ownership frequency over the whole corpus.

Every text is searched for candidates. The hashes of the candidates' values are then aggregated over the corpus by
distinct repositories and owners: a value that many owners carry is a copied example, one that stays with its owner, in
few repositories, and looks random is a live-looking credential.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, map_rows, strings

#: Base kinds, in the order in which they are listed; group 2 or the whole match is the value.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
#: Kinds that become spans unless the ownership aggregate calls their value copied. Each starts at a boundary or at a
#: mark that cannot repeat inside it, so a search stays linear in the text. Group 1 or the whole match is judged.
WIDER = {
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]{32,}"),
    "url": re.compile(r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*://[^\s:/@]+:([^\s/@]{6,})@"),
    "random": re.compile(r"[A-Za-z0-9+/_-]{28,}={0,2}"),
}
KINDS = [*BASE, *WIDER]
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_SCHEMA = """doc_id long, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string,
found array<struct<kind:int,start:int,end:int,value:string,random:boolean>>"""


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_random(value: str) -> bool:
    """Enough different characters, with digits and letters, as generated keys have."""
    return len(value) >= 12 and entropy(value) >= 3.0 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def candidates(text: str) -> list[tuple[int, int, int, str, bool]]:
    """(kind, start, end, value, whether it looks random) of a text, in code points, by start and kind; base kinds overlap others freely."""
    low, out = text.lower(), []
    for kind, (pattern, group, least) in enumerate(BASE.values()):
        if kind == 0 and not any(w in low for w in _ASSIGN_WORDS) or kind == 1 and "AKIA" not in text:
            continue
        out += [(kind, m.start(), m.end(), m[group], looks_random(m[group])) for m in pattern.finditer(text) if len(m[group]) >= least]
    # Base spans of one kind never overlap each other, so the last that starts before a match is the one to look at.
    base = [([x[1] for x in own], [x[2] for x in own]) for k in range(len(BASE)) if (own := [x for x in out if x[0] == k])]
    meets = lambda a, b: any((i := bisect_left(starts, b)) and ends[i - 1] > a for starts, ends in base)
    for kind, (name, pattern) in enumerate(WIDER.items(), len(BASE)):
        if name == "jwt" and "eyJ" not in text or name == "pem" and "PRIVATE KEY" not in text or name == "url" and "://" not in text:
            continue
        for m in pattern.finditer(text):
            random = looks_random(m[pattern.groups])
            if (name != "random" or random) and not meets(m.start(), m.end()):
                out.append((kind, m.start(), m.end(), m[0], random))
    return sorted(out, key=lambda x: (x[1], x[0]))


def _scan(batch: pa.RecordBatch) -> dict:
    found = [candidates(t) for t in strings(batch.column("text"))]
    base = [[x for x in f if x[0] < len(BASE)] for f in found]
    return {
        "doc_id": batch.column("doc_id"), "owner": batch.column("owner"), "repo": batch.column("repo"),
        **{f"n_{k}": [sum(x[0] == i for x in b) for b in base] for i, k in enumerate(BASE)},
        "base_sha256": [hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e, *_ in b).encode()).hexdigest() for b in base],
        "found": [[{"kind": k, "start": s, "end": e, "value": hashlib.sha256(v.encode()).hexdigest(), "random": r} for k, s, e, v, r in f] for f in found],
    }


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner: str = "source", repo: str = "lang", copied_owners: int = 3, spread_repos: int = 3) -> DataFrame:
    """Secrets of every text, with the verdict of the ownership aggregate.

    ``owner`` names who publishes a text; an owner's repositories are its distinct values of ``repo``. A value is
    ``copied`` if at least ``copied_owners`` owners carry it, ``live`` if it looks random (of a url, its password), and
    all that have it are fewer than ``spread_repos`` repositories of one owner, and ``shared`` otherwise. Candidates of
    the wider kinds (jwt, pem, url, random) become spans unless they are copied; base spans (assign, access, hex) always
    stay.

    Null or empty text: no spans, digest of the empty string. Null owner or repository: the value ''. Rows with the
    same or a null ``doc_id`` are each reported with their own spans. An empty table gives an empty result. Texts of any
    length are searched whole, in time linear in it. Spans that start together are ordered by kind, as listed.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, n_shared, and in n_owners and n_repos
    the most owners and repositories that carry one of the text's values.
    """
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(repo).cast("string"), F.lit("")).alias("repo"))
    scanned = checkpointed(map_rows(text, _scan, _SCHEMA).withColumn("row", F.monotonically_increasing_id()))
    each = scanned.select("row", "owner", "repo", F.explode("found").alias("c")).select("row", "owner", "repo", "c.*")
    # Distinct pairs first: partial aggregation leaves a row for each value, owner and repository in a task,
    # however often one value was copied.
    holders = each.groupBy("value", "owner", "repo").agg(F.max("random").alias("random"))
    owners = holders.groupBy("value", "owner").agg(F.count("*").alias("repos"), F.max("random").alias("random"))
    verdict = owners.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.max("random").alias("random")).select(
        "value", "owners", "repos", F.when(F.col("owners") >= copied_owners, "copied").when((F.col("owners") == 1) & (F.col("repos") < spread_repos) & F.col("random"), "live").otherwise("shared").alias("verdict"))
    # A join of two shuffled sides: Spark splits the partition of a value that very many rows carry.
    judged = each.join(verdict, "value")
    kinds = F.array(*map(F.lit, KINDS))
    span = F.when((F.col("kind") < len(BASE)) | (F.col("verdict") != "copied"), F.struct("start", "kind", "end"))
    by_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"), *(F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("live", "copied", "shared")), F.max("owners").alias("n_owners"), F.max("repos").alias("n_repos"))
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scanned.drop("found", "owner", "repo").join(by_row, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(joined, F.lit("")).alias("spans"), *(F.coalesce(f"n_{v}", F.lit(0)).alias(f"n_{v}") for v in ("live", "copied", "shared", "owners", "repos")))
