"""Secret scans in which weak candidates count only beside their other half.

Base detectors report by themselves. Weak parts (identifiers, bare secrets, endpoints) are
ordinary strings alone; an interval join within scopes of a document reports an identifier or a bare secret
only where parts that complete each other lie close together.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundtally.llm.common import digest_of, map_rows, written

#: Kinds in their order at one place. The first three are the base detectors'.
KINDS = ("assign", "access", "hex", "identifier", "secret")
#: Parts link when at most so many code points lie between them and no empty line does.
SCOPE = 240

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HINTS = ("passw", "secret", "token", "api_key", "apikey")

#: Weak parts: patterns by role. A bare secret needs a digit and letters beside its length, and is no part of an endpoint.
_WEAK = {
    "identifier": re.compile(r"""(?:\b(?:ASIA|AGPA|AIDA|AROA)[A-Z0-9]{12,}\b|\bAKIA[A-Z0-9]{8,15}\b|\b(?:client_?id|access_?key_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[\w.@-]{3,})""", re.I | re.A),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{28,}={0,2}(?![A-Za-z0-9+/_=-])"),
    "endpoint": re.compile(r"\b(?:[a-z][a-z0-9+.-]{1,20}://[^\s\"'<>]+|(?:host|endpoint|server|base_?url)[\"']?\x20*[:=]\x20*[\"']?[\w.-]+(?::\d+)?)", re.I | re.A),
}
#: Every link has a secret in it: a base span or a run of this length.
_WEAK_HINTS = re.compile(r"[A-Za-z0-9+/_-]{28}")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base detectors, by start and kind."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _bare_secrets(text: str, endpoints: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) of bare secrets, without those inside an endpoint unless they are its user's (before an @)."""
    out, k = [], 0
    for m in _WEAK["secret"].finditer(text):
        start, end = m.span()
        if not (_DIGIT.search(text, start, end) and _LETTER.search(text, start, end)):
            continue
        while k < len(endpoints) and endpoints[k][1] <= start:
            k += 1
        inside = k < len(endpoints) and endpoints[k][0] <= start and end <= endpoints[k][1]
        if inside and text[end:end + 1] == "@" and text.startswith("//", start):
            start += 2
        if (not inside or text[end:end + 1] == "@") and end - start >= 28:
            out.append((start, end))
    return out


def weak_parts(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Parts with their role, and the number of the passage (between empty lines) that holds them."""
    if not base and not _WEAK_HINTS.search(text):
        return []
    starts = [m.end() for m in re.finditer(r"\n[\x20\t\r]*\n", text)]
    parts, passage = [], 0
    found = [(m.start(), m.end(), role, False) for role in ("identifier", "endpoint") for m in _WEAK[role].finditer(text)]
    found += [(s, e, "secret", False) for s, e in _bare_secrets(text, [f[:2] for f in found if f[2] == "endpoint"])]
    found += [(s, e, "identifier" if kind == 1 else "secret", True) for s, kind, e in base]
    for start, end, role, sure in sorted(found):
        while passage < len(starts) and starts[passage] <= start:
            passage += 1
        parts.append({"role": role, "start": start, "end": end, "passage": passage, "sure": sure})
    return parts


def _scan():
    def batch(rows: dict) -> dict:
        out: dict[str, list] = {"id": rows["id"], "sha": rows["sha"], "base": [], "parts": []}
        for text in rows["text"]:
            text = text or ""
            base = base_spans(text)
            parts = weak_parts(text, base)
            out["base"].append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            # only a weak identifier or secret can be added, and only beside a part of another role
            open_ones = any(not p["sure"] and p["role"] != "endpoint" for p in parts) and len({p["role"] for p in parts}) > 1
            out["parts"].append(parts if open_ones else [])
        return out

    return batch


def linked_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, kind, start, end) of weak identifiers and secrets that lie within ``scope`` of a part that completes them.

    A secret is completed by an identifier or an endpoint, an identifier by a secret. The join's key
    is the document's row, the passage and a stretch of ``scope`` code points; every part reaches into its own stretch
    and the next ones on both sides, so a key holds a bounded number of parts. A weak part of any length is looked for
    at its start and at its end, and may come out once for each.
    """
    weak = parts.filter("not sure and role <> 'endpoint'").withColumn("cell", F.explode(F.array_distinct(F.array(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope)))))
    around = parts.select("row", "passage", F.col("role").alias("other"), F.col("start").alias("s"), F.col("end").alias("e"),
                          F.explode(F.sequence(F.floor(F.col("start") / scope) - 2, F.floor(F.col("end") / scope) + 1)).alias("cell"))
    completes = ((F.col("role") == "secret") & F.col("other").isin("identifier", "endpoint")) | ((F.col("role") == "identifier") & (F.col("other") == "secret"))
    close = (F.col("s") - F.col("end") <= scope) & (F.col("start") - F.col("e") <= scope) & ((F.col("s") >= F.col("end")) | (F.col("e") <= F.col("start")))
    return (weak.alias("w").join(around.alias("o"), (F.col("w.row") == F.col("o.row")) & (F.col("w.passage") == F.col("o.passage")) & (F.col("w.cell") == F.col("o.cell")) & completes & close, "left_semi")
            .select("row", F.when(F.col("role") == "identifier", KINDS.index("identifier")).otherwise(KINDS.index("secret")).alias("kind"), "start", "end"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(id, base, spans) of every row: arrays of (start, kind, end).

    ``spans`` holds the base spans and the linked ones, by start and kind. A null text is empty. Repeated rows and
    null ids are told apart by a row number that is fixed when the scan is written. An empty table gives no rows.
    """
    return _scanned(docs.select(docs[id_col].cast("long").alias("id"), F.lit(None).cast("string").alias("sha"), docs[text_col].alias("text")), scope).drop("sha")


def _scanned(rows: DataFrame, scope: int) -> DataFrame:
    """(id, sha, base, spans) of (id, sha, text); the first two are passed on."""
    span = "array<struct<start:int,kind:int,end:int>>"
    schema = f"id long, sha string, base {span}, parts array<struct<role:string,start:int,end:int,passage:int,sure:boolean>>"
    found = written(map_rows(rows, schema, _scan).withColumn("row", F.monotonically_increasing_id()))
    more = (linked_parts(found.filter(F.size("parts") > 0).select("row", F.inline("parts")), scope)
            .groupBy("row").agg(F.collect_set(F.struct("start", "kind", "end")).alias("more")))
    return (found.join(more, "row", "left")
            .select("id", "sha", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(span)))).alias("spans")))


def span_digests(scanned: DataFrame) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans as text)."""
    names = F.array(*[F.lit(k) for k in KINDS])
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")
    number = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")
    return scanned.select("id", *[number(k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", scope: int = SCOPE, mask: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with every reported span replaced by ``mask`` and, if there is such a column, the length set anew.

    Rows meet their spans by id and digest of the text, so that rows without an id or with the same one are each masked by their own.
    """
    number, digest = docs[id_col].cast("long"), digest_of(docs[text_col])
    key = lambda i, sha: F.concat(F.coalesce(i.cast("string"), F.lit("")), F.lit(":"), sha)
    found = _scanned(docs.select(number.alias("id"), digest.alias("sha"), docs[text_col].alias("text")), scope).filter(F.size("spans") > 0)
    hits = found.select(key(F.col("id"), F.col("sha")).alias("doc_key"), F.col("spans").alias("hit_spans")).dropDuplicates(["doc_key"])
    joined = docs.select(F.struct("*").alias("doc"), key(number, digest).alias("doc_key")).join(hits, "doc_key", "left")
    text = F.col("doc").getField(text_col)
    state = F.aggregate(
        F.col("hit_spans"), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.when(s.start >= acc.at, F.concat(acc.out, F.substring(text, acc.at + 1, s.start - acc.at), F.lit(mask))).otherwise(acc.out).alias("out"),
            F.greatest(acc.at, s.end).alias("at")))
    masked = F.when(F.col("hit_spans").isNull(), text).otherwise(F.concat(state.out, F.substring(text, state["at"] + 1, F.char_length(text))))
    out = joined.select("doc", masked.alias("masked"))
    fields = []
    for f in docs.schema.fields:
        value = F.col("doc").getField(f.name)
        if f.name == text_col:
            value = F.col("masked")
        elif f.name == length_col:
            value = F.when(F.col("masked").eqNullSafe(text), value).otherwise(F.char_length("masked").cast(f.dataType))
        fields.append(value.alias(f.name))
    return out.select(*fields)

