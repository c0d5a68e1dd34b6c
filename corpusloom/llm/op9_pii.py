"""Operator 9: personal data. Base patterns, and information-theoretic sanitisation of the terms around them.

Pass 1 reads every whole text once. It finds the base spans, lists the terms (words of four letters and digits or more, not
of digits alone) within SPAN_WORDS words of each span together with the protected entity (the span's text), and counts
in how many documents each term and each initial occurs anywhere (per task, then summed by a shuffle on the term's hash).

Co-occurrence then tells how much a term discloses: with n(t) documents holding t, n(e) holding e and n(t, e) holding t
near e, the pointwise mutual information of t and e as a share of e's information content is
1 + log n(t, e)/n(t) / log(N/n(e)). A term is disclosing when that share reaches DISCLOSURE, and either the pair occurs in
SUPPORT different texts or the term reads like a name or an identifier beside the entity (it holds a digit, or a capital
inside a sentence): a rare ordinary word beside an entity that is seen once or twice is chance, a name isn't.

Pass 2 reads the texts that hold an entity with disclosing terms, and marks every occurrence of those terms in them, near
the entity or not, as spans of kind "term". A term is generalised to its initial if that discloses less than DISCLOSURE
of each entity concerned (the initial's share, from n(initial), with n(e) as the most that they can have in common), and
else removed.

``sanitise`` replaces base spans by their kind, generalised terms by their initial and a full stop, and removed ones by <TERM>.

A very long text is held whole in one task, as Python strings of its words.

Cases: null or empty text has no spans; null doc_ids stay null; rows with the same doc_id get a row each; an empty
table gives no rows; other columns are ignored, whatever their names (``sanitise`` keeps them).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Covered, Scratch, field, slices

#: The base patterns and their order.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "term", "term")
#: Kind numbers of terms that are generalised and removed; both are called "term".
GENERAL, REMOVED = 4, 5

SPAN_WORDS, TERM_CHARS = 8, 4
DISCLOSURE, SUPPORT = 0.9, 3
WORD = re.compile(r"[^\x20\x09-\x0D]+")


#: IP's matches in linear time: it can only start at the start of a run of digits, and no shorter run helps.
_IP_ONCE = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _good_ip(m: re.Match) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))


def _good_card(m: re.Match) -> bool:
    digits = re.sub("[^0-9]", "", m[0])
    return 16 <= len(digits) <= 19 and luhn(digits)


def _good_phone(m: re.Match) -> bool:
    return 8 <= sum(c.isdigit() for c in m[0]) <= 15


def _emails(text: str) -> Iterator[re.Match]:
    """EMAIL's matches; the pattern starts only where a run of local-part characters ends at an @, so others are skipped."""
    at, done = text.find("@"), 0
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        m = EMAIL.match(text, a) if a < at else None
        if m:
            yield m
            done = m.end()
        at = text.find("@", max(at + 1, done))


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile("[0-9]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), leftmost and non-overlapping per kind, failing matches dropped without retries."""
    out = [(0, *m.span()) for m in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        if "." in text:
            out += [(1, *m.span()) for m in _IP_ONCE.finditer(text) if _good_ip(m)]
        out += [(2, *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 16 and _good_card(m)]
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if _good_phone(m)]
    return out


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _term(word: str) -> str | None:
    """The term of a word: outer punctuation off, lower case; None if it isn't one."""
    t = word.strip("\"'(),-./:;?@[]^_`{}~+=!#*$%&|<>").lower()
    return t if len(t) >= TERM_CHARS and t.isalnum() and not t.isdigit() else None


def _initial(term: str) -> str:
    """ASCII initial of a term, "*" for others."""
    return term[0] if term[0].isascii() else "*"


def _named(text: str, s: int, e: int) -> bool:
    """Whether the word reads like a name or an identifier: it holds a digit, or begins with a capital inside a sentence."""
    word = text[s:e].lstrip("\"'(),-./:;?@[]^_`{}~+=!#*$%&|<>")
    before = text[max(0, s - 2) : s].rstrip(" ")
    return any(c.isdigit() for c in word) or (word[:1].isupper() and bool(before) and before[-1] not in ".?!:;\n\r\t|")


def entity(text: str, span: tuple[int, int, int]) -> int:
    return _hash(f"{span[0]}:{text[span[1] : span[2]].lower()}")


def contexts(text: str, spans: list[tuple[int, int, int]]) -> set[tuple[int, int, bool]]:
    """(entity, term, reads like a name) of the terms within SPAN_WORDS words of each span, spans' own words apart."""
    if not spans:
        return set()
    words = [m.span() for m in WORD.finditer(text)]
    starts = np.array([a for a, _ in words])
    ends = np.array([b for _, b in words])
    out, covered = set(), Covered([(a, b) for _, a, b in spans])
    for k, a, b in spans:
        who = entity(text, (k, a, b))
        left, right = int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(starts, b))
        for i in [*range(max(0, left - SPAN_WORDS), left), *range(right, min(len(words), right + SPAN_WORDS))]:
            s, e = words[i]
            if covered.overlaps(s, e):
                continue
            if t := _term(text[s:e]):
                out.add((who, _hash(t), _named(text, s, e)))
    return out


def marks(text: str, spans: list[tuple[int, int, int]], least: dict[int, float], initials: dict[str, int]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every occurrence of the terms of ``least`` outside the spans; a term is generalised if its
    initial occurs in more documents than ``least`` says."""
    out, covered, seen = [], Covered([(a, b) for _, a, b in spans]), {}
    for m in WORD.finditer(text):
        if m[0] not in seen:
            t = _term(m[0])
            need = least.get(_hash(t)) if t else None
            seen[m[0]] = None if need is None else GENERAL if initials.get(_initial(t), 0) > need else REMOVED
        if seen[m[0]] is not None and not covered.overlaps(*m.span()):
            out.append((seen[m[0]], *m.span()))
    return out


ROW = "rid long, counts array<long>, base_sha256 string, base array<struct<k:int,s:long,e:long>>, near array<struct<entity:long,term:long,named:boolean>>, entities array<long>, held string, text_hash long, terms binary, docs binary, initials map<string,long>, total long"


def _term_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """Hash of each distinct term of some texts, how many of them hold it, and how many hold a term with each initial."""
    terms: dict[str, int | None] = {}
    first: dict[str, str] = {}
    n: dict[int, int] = {}
    initials: dict[str, int] = {}
    for t in texts:
        seen, letters = set(), set()
        for w in set(t.split()):
            h = terms.get(w, 0)
            if h == 0:
                k = _term(w)
                h = terms[w] = _hash(k) if k else None
                if k:
                    first[w] = _initial(k)
            if h is not None:
                seen.add(h)
                letters.add(first[w])
        for h in seen:
            n[h] = n.get(h, 0) + 1
        for c in letters:
            initials[c] = initials.get(c, 0) + 1
    return np.fromiter(n.keys(), np.int64, len(n)), np.fromiter(n.values(), np.int64, len(n)), initials


def _scan(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Pass 1 over ``docs`` (the columns ``carry`` stay, as the struct ``row``): a row per document with its spans and
    contexts, and rows of term counts (``terms`` set). ``rid`` numbers the rows as written, so later joins agree on it."""
    near = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64()), ("named", pa.bool_())]))
    span = pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int64()), ("e", pa.int64())]))
    names = ["row", "rid", "counts", "base_sha256", "base", "near", "entities", "held", "text_hash", "terms", "docs", "initials", "total"]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.string(), span, near, pa.list_(pa.int64()), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.map_(pa.string(), pa.int64()), pa.int64()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "_text"):
            rows = []
            for t in texts:
                base = base_spans(t)
                found = sorted(contexts(t, base))
                who = sorted({entity(t, x) for x in base})
                n = [sum(k == i for k, _, _ in base) for i in range(4)]
                rows.append((n, hashlib.sha256(join_spans(base).encode()).hexdigest(), [{"k": k, "s": a, "e": b} for k, a, b in base], [{"entity": x, "term": y, "named": z} for x, y, z in found], who, t if base else None, _hash(t), None, None, None, None))
            row = field(batch, "row")
            yield pa.RecordBatch.from_arrays([row, field(batch, "rid"), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds[1:], strict=True))], names=names)
            terms, many, initials = _term_counts(texts)
            last = (None, None, None, None, None, None, None, None, terms.astype("<i8").tobytes(), many.astype("<i4").tobytes(), list(initials.items()), len(texts))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, row.type), *(pa.array([x], k) for x, k in zip(last, kinds, strict=True))], names=names)

    from pyspark.sql import types as S

    rows = docs.select(F.struct(*[F.col(c) for c in carry]).alias("row"), F.monotonically_increasing_id().alias("rid"), F.col("text").cast("string").alias("_text"))
    schema = S.StructType([S.StructField("row", rows.schema["row"].dataType, True), *S._parse_datatype_string(ROW).fields])
    return rows.mapInArrow(scan, schema)


def disclosing(scanned: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(entity, term, least) of the pairs whose co-occurrence discloses the entity, from the counts of the whole corpus;
    an initial that occurs in more than ``least`` documents discloses too little of the entity."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(t, "<i8")), pa.array(np.frombuffer(n, "<i4").astype(np.int64))], names=["term", "n_term"])

    near = scanned.where("terms is null and size(near) > 0").select("rid", "text_hash", F.explode("near").alias("x")).groupBy("rid", "text_hash", "x.entity", "x.term").agg(F.max("x.named").alias("named"))
    pairs = near.groupBy("entity", "term", "text_hash").agg(F.count("*").alias("n"), F.max("named").alias("named")).groupBy("entity", "term").agg(F.sum("n").alias("n_pair"), F.count("*").alias("texts"), F.max("named").alias("named")).where((F.col("texts") >= support) | F.col("named"))
    with_entity = scanned.where("terms is null and size(entities) > 0").select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    per_term = scanned.where("terms is not null").select("terms", "docs").mapInArrow(unpack, "term long, n_term long")
    wanted = pairs.select("term").distinct()
    per_term = per_term.groupBy("term").agg(F.sum("n_term").alias("n_term")).join(wanted, "term", "left_semi")
    total = scanned.where("terms is not null").agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    content = F.log(F.lit(float(max(total, 1))) / F.col("n_entity"))
    share = F.when(content > 0, 1 + F.log(F.least(F.col("n_pair") / F.col("n_term"), F.lit(1.0))) / content).otherwise(F.lit(0.0))
    return pairs.join(per_term, "term").join(with_entity, "entity").where(share >= disclosure).select("entity", "term", (F.col("n_entity") * F.exp((1 - disclosure) * content)).alias("least"))


_MARK = "array<struct<k:int,s:bigint,e:bigint>>"


def _with_marks(scratch: Scratch, docs: DataFrame, carry: list[str]) -> DataFrame:
    """Pass 1's rows with ``found``: base spans and disclosing terms, by kind and start. Only rows that hold an entity are joined."""
    scanned = scratch.write(_scan(docs, carry), "scanned")
    pairs = scratch.write(disclosing(scanned), "pairs")
    initials = {r[0]: r[1] for r in scanned.where("terms is not null").select(F.explode("initials").alias("c", "n")).groupBy("c").agg(F.sum("n")).collect()}  # ASCII initials
    per_doc = scanned.where("terms is null")
    hits = per_doc.where("size(entities) > 0").select("rid", F.explode("entities").alias("entity")).join(pairs, "entity").groupBy("rid", "term").agg(F.max("least").alias("least"))
    hits = hits.groupBy("rid").agg(F.collect_list(F.struct("term", "least")).alias("hits"))  # terms of one document

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int64()), ("e", pa.int64())]))
        for batch, texts in slices(batches, "held"):
            rows = []
            for t, base, found in zip(texts, field(batch, "base").to_pylist(), field(batch, "hits").to_pylist(), strict=True):
                spans = marks(t, [(z["k"], z["s"], z["e"]) for z in base], {h["term"]: h["least"] for h in found}, initials)
                rows.append([{"k": k, "s": a, "e": b} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([field(batch, "rid"), pa.array(rows, kind)], names=["rid", "marks"])

    marked = per_doc.where("size(entities) > 0").select("rid", "held", "base").join(hits, "rid").mapInArrow(mark, f"rid long, marks {_MARK}")
    none = F.array().cast(_MARK)
    plain = per_doc.where("size(entities) = 0").withColumn("marks", none)
    joined = per_doc.where("size(entities) > 0").join(marked, "rid", "left").withColumn("marks", F.coalesce("marks", none))
    both = plain.unionByName(joined).drop("held")
    order = F.array_sort(F.transform(F.concat("base", "marks"), lambda z: F.struct(F.least(z["k"], F.lit(GENERAL)).alias("o"), z["s"].alias("s"), z["e"].alias("e"), z["k"].alias("k"))))
    return both.withColumn("found", F.transform(order, lambda z: F.struct(z["k"].alias("k"), z["s"].alias("s"), z["e"].alias("e"))))


def find_personal_data(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts, base hash, and all spans as a string and as an array."""
    out = _with_marks(Scratch(spark, "op9"), docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), ["doc_id"])
    names = F.array(*map(F.lit, KINDS))
    text = F.transform("found", lambda z: F.concat_ws(":", F.get(names, z["k"]), z["s"].cast("string"), z["e"].cast("string")))
    counts = [F.col("counts")[i].alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    shown = F.transform("found", lambda z: F.struct(F.get(names, z["k"]).alias("kind"), z["s"].alias("start"), z["e"].alias("end")))
    return out.select("row.doc_id", *counts, "base_sha256", F.array_join(text, ",").alias("spans"), F.size("marks").cast("long").alias("n_term"), shown.alias("found"))


def clean_text(text: str, found: list[tuple[int, int, int]]) -> str:
    """Spans replaced: base kinds by <KIND>, generalised terms by their initial, removed ones by <TERM>; overlapping spans by the first's."""
    out, at = [], 0
    for a, b, k in sorted((a, -b, k) for k, a, b in found):
        b = -b
        if a >= at:
            letter = (_term(text[a:b]) or "")[:1].upper()
            out += [text[at:a], f"{letter}." if k == GENERAL and letter else f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def sanitise(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs``, all rows and columns, with personal data and disclosing terms replaced (``n_chars`` follows the text)."""
    marked = _with_marks(Scratch(spark, "op9s"), docs, docs.columns)
    dirty = marked.where("size(found) > 0").select("row", F.col("row.text").alias("_text"), "found")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "_text"):
            spans = field(batch, "found").to_pylist()
            new = [clean_text(t, [(z["k"], z["s"], z["e"]) for z in f]) for t, f in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([field(batch, "row"), pa.array(new, pa.string())], names=["row", "new_text"])

    from pyspark.sql import types as S

    schema = S.StructType([S.StructField("row", dirty.schema["row"].dataType, True), S.StructField("new_text", S.StringType(), True)])
    new = {"text": F.col("new_text")} | ({"n_chars": F.length("new_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    cleaned = dirty.mapInArrow(rewrite, schema).select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
    return marked.where("size(found) = 0").select(*[F.col("row").getField(c).alias(c) for c in docs.columns]).unionByName(cleaned)
