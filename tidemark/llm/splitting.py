"""Oversized texts cut into overlapping pieces at natural boundaries, without a whole text in any task.

1. A text is cut into ranges: rows of text into RANGE characters, in one walk over the text; files into byte ranges
   that are read by offset, with the bytes of a character that reaches over the edge as halo (`file_ranges`). In each
   range a worker detects the boundaries: places where a token begins in any context (before white space, after a full
   stop of scripts without spaces), with a level (blank line, line, sentence, word). What lies between the range's edge
   and its nearest boundary stays open.
2. Stitching: the open ends on both sides of an edge (and ranges without any boundary between them) are joined and
   counted as one segment. So each segment is counted in its own context, and the counts add up to those of the
   whole text exactly.
3. Prefix sums over the ranges, on rows of a few numbers, give each boundary its place in tokens.
4. Piece k ends at the best boundary (highest level, then the last) within SLACK tokens before the place
   limit + (k-1) * (limit - SLACK - overlap), and the next begins up to `overlap` tokens before that. So each range
   finds its cuts on its own, with the last boundaries of the nearest range before it as halo.
5. Pieces are cut out of the ranges they touch, by offset, and put together.

Between two boundaries the tokens of a piece are known from their places. Segments longer than STEP tokens without a
boundary inside get places between two tokens; a piece that begins or ends there may tokenise otherwise, so only such
pieces are counted again and halved in the rare case that they exceed the limit.

Defined cases: null and empty texts have no tokens; texts up to the limit are left out (they need no splitting). A
repeated id is an error of the input: ids must be unique. Empty tables give no pieces. Bytes of files that are no UTF-8
become U+FFFD. White space stays with the piece that follows it; pieces, less their overlaps, give the text back exactly.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.runtime import cut

LIMIT, OVERLAP, SLACK, STEP = 1024, 64, 128, 16
RANGE = 32_768
_SPACE = "[\t-\r \u0085   -     　]"
_BOUNDARY = re.compile(f"(?<!{_SPACE})(?<=.){_SPACE}+|(?<=[。！？])(?=[^\\W_])", re.S)
_ENDS = frozenset(".!?。！？…")


def _bytes_before(text: str) -> np.ndarray | None:
    """Byte offsets of the characters; None: the same as the character offsets."""
    if text.isascii():
        return None
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "uint32")
    return np.concatenate([[0], np.cumsum(1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))])


def boundaries(text: str) -> list[tuple[int, int]]:
    """(position, level) of the places where a token begins in any context; 3: blank line, 2: line, 1: sentence, 0: word."""
    out = []
    for m in _BOUNDARY.finditer(text):
        p, gap = m.start(), m.group()
        lines = gap.count("\n")
        out.append((p, 3 if lines > 1 else 2 if lines else 1 if text[p - 1] in _ENDS else 0))
    return out


def measure(text: str, lengths: list[int], encode, at: list[tuple[int, int]]) -> tuple[list[int], list[int], list[int]]:
    """Positions, tokens before them, and levels of the boundaries kept in a text, the last being its end.

    Word boundaries closer than STEP tokens to the one before are left out; stretches of more than STEP tokens
    without any get places between two tokens (level -1).
    """
    ends = np.cumsum(np.fromiter((lengths[t] for t in encode(text)), "int64"))  # bytes after each token
    of = _bytes_before(text)
    pos = np.array([p for p, _ in at] + [len(text)], "int64")
    level = np.array([v for _, v in at] + [0], "int64")
    b = pos if of is None else of[pos]
    n = np.searchsorted(ends, b)
    whole = ends[np.minimum(n, len(ends) - 1)] == b  # boundaries are ends of tokens by construction
    p_out, n_out, l_out, last = [], [], [], 0
    for p, k, v, ok in zip(pos.tolist(), (n + 1).tolist(), level.tolist(), whole.tolist(), strict=True):
        end = p == len(text)
        if not end and (not ok or (v == 0 and k - last < STEP)):
            continue
        while k - last > 2 * STEP:  # no boundary for long: between tokens, where a character ends
            q = last + STEP
            while q < k:
                byte = ends[q - 1]
                c = byte if of is None else int(np.searchsorted(of, byte))
                if of is None or of[c] == byte:
                    break
                q += 1
            if q >= k:
                break
            p_out.append(int(c))
            n_out.append(q)
            l_out.append(-1)
            last = q
        p_out.append(p)
        n_out.append(k)
        l_out.append(v)
        last = k
    return p_out, n_out, l_out


def _worker(folder: str):
    e = tokens.encoding(folder)
    return e.encode_ordinary, [len(e.decode_single_token_bytes(i)) for i in range(e.n_vocab)]


_cache: dict = {}


def _tools(folder: str):
    if folder not in _cache:
        _cache[folder] = _worker(folder)
    return _cache[folder]


_RANGE = "range_no long, start long, n_chars long, is_last boolean, single boolean"
_PART = 1 << 21  # characters of ranges in an Arrow batch


def text_ranges(docs: DataFrame, limit: int, doc_id: str, text: str, size: int) -> DataFrame:
    """(doc_id, range_no, start, n_chars, is_last, single, chunk) of the texts that can exceed the limit (a token has a
    byte at least). single: the text is one range."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.octet_length("text") > limit)
    names = ["doc_id", "range_no", "start", "n_chars", "is_last", "single", "chunk"]

    def go(batches):
        for b in batches:
            rows, held = [], 0
            for i, t in zip(b.doc_id, b.text, strict=True):
                for no, at in enumerate(range(0, len(t), size)):
                    chunk = t[at : at + size]
                    rows.append((i, no, at, len(chunk), at + size >= len(t), len(t) <= size, chunk))
                    held += len(chunk)
                    if held >= _PART:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return cut(d.mapInPandas(go, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {_RANGE}, chunk string"))


def _read_at(path: str, at: int, size: int, opened: dict) -> str:
    """The characters that begin in the bytes [at, at + size) of a file on any file system that pyarrow knows."""
    if path not in opened:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        opened.clear()
        opened[path] = system.open_input_file(inner)
    raw = opened[path].read_at(size + 3, at)
    inside = lambda k: k < len(raw) and raw[k] & 0xC0 == 0x80
    lo, hi = 0, size
    while at and lo < 3 and inside(lo):
        lo += 1
    while hi < size + 3 and inside(hi):
        hi += 1
    return raw[lo:hi].decode("utf-8", "replace")


def _read(table: DataFrame) -> DataFrame:
    """Adds `chunk` to rows of file_ranges, by offset."""
    if "chunk" in table.columns:
        return table

    def go(batches):
        opened: dict = {}
        for b in batches:
            for k in range(0, len(b), 16):
                p = b.iloc[k : k + 16]
                yield p.assign(chunk=[_read_at(i, at, n, opened) for i, at, n in zip(p.doc_id, p.byte_at, p.bytes, strict=True)])

    return table.mapInPandas(go, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema) + ", chunk string")


def file_ranges(spark: SparkSession, pattern: str, size: int = RANGE) -> DataFrame:
    """(doc_id, range_no, start, n_chars, is_last, single, byte_at, bytes): the byte ranges of all files of a pattern.

    doc_id is the file's URI, start its first character by a prefix sum over the ranges' lengths. No text is kept.
    """
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [(f.getPath().toUri().toString(), f.getLen()) for f in system.globStatus(path) or [] if f.isFile()]  # a row a file
    found = [(u.replace("file:/", "file:///", 1) if u.startswith("file:/") and not u.startswith("file:///") else u, n) for u, n in found]
    f = spark.createDataFrame(found, "doc_id string, len long").filter("len > 0")
    x = f.select("doc_id", "len", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("len") - 1) / size))).alias("range_no"))
    x = x.repartition("doc_id", "range_no").withColumns({"byte_at": F.col("range_no") * size, "bytes": F.lit(size).cast("long")})
    n = cut(_read(x).select("doc_id", "len", "range_no", "byte_at", "bytes", F.length("chunk").cast("long").alias("n_chars")))
    before = F.sum("n_chars").over(Window.partitionBy("doc_id").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1))
    return cut(n.select("doc_id", "range_no", F.coalesce(before, F.lit(0).cast("long")).alias("start"), "n_chars", ((F.col("range_no") + 1) * size >= F.col("len")).alias("is_last"), (F.col("len") <= size).alias("single"), "byte_at", "bytes"))


_TABLE = "range_no long, single boolean, pos array<long>, tok array<int>, lev array<int>, head string, head_at long, tail string, tail_at long"


def boundary_tables(r: DataFrame, folder: str) -> DataFrame:
    """Of each range the boundaries and the tokens before them, counted from its first boundary; the open ends."""
    kind = r.schema["doc_id"].dataType.simpleString()

    def go(batches):
        encode, lengths = _tools(folder)
        for x in batches:
            rows = []
            for i, no, start, last, single, chunk in zip(x.doc_id, x.range_no, x.start, x.is_last, x.single, x.chunk, strict=True):
                at = boundaries(chunk)
                lo = 0 if no == 0 else at[0][0] if at else None
                hi = len(chunk) if last else at[-1][0] if at else None
                if lo is None or hi is None or hi < lo:  # no boundary: all open, to one side if it is the first or last
                    rows.append((i, no, single, [], [], [], None, start, chunk, start))
                    continue
                body = chunk[lo:hi]
                pos, tok, lev = measure(body, lengths, encode, [(p - lo, v) for p, v in at if lo < p < hi]) if body else ([], [], [])
                if pos and not last:
                    lev[-1] = at[-1][1]
                if no:  # the first boundary itself closes the open end before it
                    pos, tok, lev = [0, *pos], [0, *tok], [at[0][1], *lev]
                rows.append((i, no, single, [p + start + lo for p in pos], tok, lev, chunk[:lo] if no else None, start, chunk[hi:], start + hi))
            yield pd.DataFrame(rows, columns=["doc_id", "range_no", "single", "pos", "tok", "lev", "head", "head_at", "tail", "tail_at"])

    return _read(r).mapInPandas(go, f"doc_id {kind}, {_TABLE}")


def _stitched(t: DataFrame, folder: str) -> DataFrame:
    """(doc_id, range_no, gap, g_pos, g_tok): tokens of the open text that ends at the first boundary of the range (or,
    where no boundary follows, belongs to the last range), and the places inside it where it is long."""
    kind = t.schema["doc_id"].dataType.simpleString()
    w = Window.partitionBy("doc_id").orderBy("range_no")
    anchor = F.when(F.col("closes"), F.col("range_no"))
    end = F.max("range_no").over(Window.partitionBy("doc_id"))
    # where each range's open end goes: on rows of two numbers
    to = t.select("doc_id", "range_no", F.col("head").isNotNull().alias("closes")).select("doc_id", "range_no", F.coalesce(F.first(anchor, True).over(w.rowsBetween(1, Window.unboundedFollowing)), end).alias("to"))
    parts = t.filter("tail != ''").select("doc_id", "range_no", F.col("tail_at").alias("at"), F.col("tail").alias("part")).join(to, ["doc_id", "range_no"]).select("doc_id", "to", "at", "part")
    parts = parts.unionByName(t.filter("head != ''").select("doc_id", F.col("range_no").alias("to"), F.col("head_at").alias("at"), F.col("head").alias("part")))
    joined = parts.groupBy("doc_id", "to").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("p"))
    joined = joined.select("doc_id", "to", F.col("p")[0]["at"].alias("start"), F.array_join(F.transform("p", lambda x: x["part"]), "").alias("open"))

    def count(batches):
        encode, lengths = _tools(folder)
        for x in batches:
            rows = []
            for i, to, start, text in zip(x.doc_id, x.to, x.start, x.open, strict=True):
                pos, tok, _ = measure(text, lengths, encode, [])
                rows.append((i, to, tok[-1], [start + q for q in pos[:-1]], tok[:-1]))
            yield pd.DataFrame(rows, columns=["doc_id", "range_no", "gap", "g_pos", "g_tok"])

    return joined.mapInPandas(count, f"doc_id {kind}, range_no long, gap long, g_pos array<long>, g_tok array<int>")


def placed_tables(r: DataFrame, limit: int, folder: str) -> DataFrame:
    """(doc_id, range_no, single, base, total, src, pos, tok, lev) of the texts over the limit: tokens before the range's
    own text, those of the whole text, and the nearest range before it that has places."""
    t = cut(boundary_tables(r, folder))
    own = F.when(F.size("tok") > 0, F.element_at("tok", -1)).otherwise(0).cast("long")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    alone = t.filter("single").select("doc_id", "range_no", "single", zero.alias("base"), own.alias("total"), none.alias("src"), "pos", "tok", "lev")
    many = t.filter("not single")
    gaps = cut(_stitched(many, folder))
    # prefix sums over a few numbers a range
    w = Window.partitionBy("doc_id").orderBy("range_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    n = many.select("doc_id", "range_no", own.alias("own"), (F.size("pos") > 0).alias("some")).join(gaps.select("doc_id", "range_no", "gap", (F.size("g_pos") > 0).alias("more")), ["doc_id", "range_no"], "left")
    n = n.select("doc_id", "range_no", (F.coalesce("gap", zero) + F.col("own")).alias("sum"), F.when(F.col("some") | F.coalesce("more", F.lit(False)), F.col("range_no")).alias("has"))
    n = n.select("doc_id", "range_no", F.coalesce(F.sum("sum").over(before), zero).alias("base"), F.sum("sum").over(Window.partitionBy("doc_id")).alias("total"), F.last("has", True).over(before).alias("src"))
    x = many.select("doc_id", "range_no", "single", "pos", "tok", "lev").join(n.filter(F.col("total") > limit), ["doc_id", "range_no"]).join(gaps, ["doc_id", "range_no"], "left")
    gap = F.coalesce("gap", zero)
    inner = lambda c, k: F.coalesce(c, F.array().cast(f"array<{k}>"))
    x = x.select(
        "doc_id", "range_no", "single", "base", "total", "src",
        F.concat(inner("g_pos", "bigint"), "pos").alias("pos"),
        F.concat(inner("g_tok", "int"), F.transform("tok", lambda k: (k + gap).cast("int"))).alias("tok"),
        F.concat(F.transform(inner("g_pos", "bigint"), lambda _: F.lit(-1)), "lev").alias("lev"),
    )
    return alone.filter(F.col("total") > limit).unionByName(x)


def token_totals(docs: DataFrame, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text", folder: str = tokens.FOLDER, size: int = RANGE) -> DataFrame:
    """(doc_id, n_tokens) of the texts over the limit."""
    return placed_tables(text_ranges(docs, limit, doc_id, text, size), limit, folder).groupBy("doc_id").agg(F.first("total").alias("n_tokens"))


def split(docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, slack: int = SLACK, doc_id: str = "doc_id", text: str = "text", folder: str = tokens.FOLDER, size: int = RANGE) -> DataFrame:
    """(doc_id, piece_no, start, end, n_tokens, text): the pieces of every text over the limit, in characters."""
    return split_ranges(text_ranges(docs, limit, doc_id, text, size), limit, overlap, slack, folder, size)


def split_files(spark: SparkSession, pattern: str, limit: int = LIMIT, overlap: int = OVERLAP, slack: int = SLACK, folder: str = tokens.FOLDER, size: int = RANGE) -> DataFrame:
    """As split, of text files of any length; doc_id is the file. No task reads more than ranges of a file."""
    return split_ranges(file_ranges(spark, pattern, size), limit, overlap, slack, folder, size)


def split_ranges(r: DataFrame, limit: int, overlap: int, slack: int, folder: str, size: int) -> DataFrame:
    """The pieces of text_ranges or file_ranges."""
    if limit < overlap + slack + 4 * STEP:
        raise ValueError("the limit must exceed overlap + slack + 4 * STEP")
    kind = r.schema["doc_id"].dataType.simpleString()
    stride = limit - slack - overlap
    halo = slack + overlap + 1  # boundaries lie a token apart at least
    t = cut(placed_tables(r, limit, folder))
    place = F.transform("tok", lambda k: k + F.col("base"))
    keep = lambda c: F.slice(c, F.greatest(F.size(c) - F.lit(halo), F.lit(0)) + 1, F.lit(halo))
    x = t.select("doc_id", "range_no", "single", "total", "src", "pos", place.alias("at"), "lev")
    prev = x.filter("not single and size(pos) > 0").select("doc_id", F.col("range_no").alias("src"), *[keep(c).alias(f"p_{c}") for c in ("pos", "at", "lev")])
    many = x.filter("not single").join(prev, ["doc_id", "src"], "left")
    many = many.select("doc_id", "total", *[F.concat(F.coalesce(f"p_{c}", F.array().cast(f"array<{k}>")), F.col(c).cast(f"array<{k}>")).alias(c) for c, k in (("pos", "bigint"), ("at", "bigint"), ("lev", "int"))], F.coalesce(F.element_at("p_at", -1), F.lit(0).cast("long")).alias("lo"))
    x = x.filter("single").select("doc_id", "total", "pos", "at", "lev", F.lit(0).cast("long").alias("lo")).unionByName(many).filter("size(at) > 0")

    def cuts(batches):
        for b in batches:
            rows = []
            for i, total, lo, pos, at, lev in zip(b.doc_id, b.total, b.lo, b.pos, b["at"], b.lev, strict=True):
                pos, at, lev = np.asarray(pos), np.asarray(at), np.asarray(lev)
                # places beyond which a piece is still too long; a range has those up to its own last boundary
                k = max(1, 1 + -(-(lo + 1 - limit) // stride)) if lo >= limit else 1
                last_k = -(-(total - limit) // stride)
                while k <= last_k and limit + (k - 1) * stride <= at[-1]:
                    goal = limit + (k - 1) * stride
                    if goal > lo:
                        a, z = np.searchsorted(at, goal - slack, "right"), np.searchsorted(at, goal, "right")
                        j = a + int(np.lexsort((at[a:z], lev[a:z]))[-1]) if z > a else max(0, z - 1)
                        s = min(int(np.searchsorted(at, at[j] - overlap)), j)
                        rows.append((i, k, int(pos[j]), int(at[j]), bool(lev[j] >= 0), int(pos[s]), int(at[s]), bool(lev[s] >= 0)))
                    k += 1
            yield pd.DataFrame(rows, columns=["doc_id", "k", "end", "end_at", "end_clean", "next", "next_at", "next_clean"])

    found = cut(x.mapInPandas(cuts, f"doc_id {kind}, k long, end long, end_at long, end_clean boolean, next long, next_at long, next_clean boolean"))
    last = r.filter("is_last").select("doc_id", (F.col("start") + F.col("n_chars")).alias("end"))
    whole_texts = t.select("doc_id", "total").distinct()
    last_k = F.ceil((F.col("total") - limit) / stride) + 1
    ends = last.join(whole_texts, "doc_id").select("doc_id", last_k.cast("long").alias("k"), "end", F.col("total").alias("end_at"), F.lit(True).alias("end_clean"))
    # piece k + 1 begins where the cut of piece k says
    starts = found.select("doc_id", (F.col("k") + 1).alias("k"), F.col("next").alias("start"), "next_at", "next_clean")
    p = found.select("doc_id", "k", "end", "end_at", "end_clean").unionByName(ends).join(starts, ["doc_id", "k"], "left")
    clean = F.col("end_clean") & F.coalesce("next_clean", F.lit(True))
    p = p.select("doc_id", "k", F.coalesce("start", F.lit(0).cast("long")).alias("p_start"), F.col("end").alias("p_end"), (F.col("end_at") - F.coalesce("next_at", F.lit(0).cast("long"))).alias("n"), clean.alias("clean"))
    # a piece and the ranges it touches meet in buckets of `size` characters, each pair in the first bucket of both
    bucket = lambda c: F.floor(c / size)
    pb = p.withColumn("bucket", F.explode(F.sequence(bucket(F.col("p_start")), bucket(F.greatest(F.col("p_end") - 1, F.col("p_start"))))))
    stop = F.col("start") + F.col("n_chars")
    rb = r.join(whole_texts.select("doc_id"), "doc_id", "left_semi").filter("n_chars > 0").withColumn("bucket", F.explode(F.sequence(bucket(F.col("start")), bucket(stop - 1))))
    touched = pb.join(_read(rb), ["doc_id", "bucket"]).filter((F.col("p_start") < stop) & (F.col("p_end") > F.col("start")) & (F.col("bucket") == F.greatest(bucket(F.col("p_start")), bucket(F.col("start")))))
    skip = F.greatest(F.col("p_start") - F.col("start"), F.lit(0).cast("long"))
    part = F.substring("chunk", (skip + 1).cast("int"), (F.least(F.col("p_end"), stop) - F.col("start") - skip).cast("int"))
    touched = touched.select("doc_id", "k", "p_start", "p_end", "n", "clean", "range_no", part.alias("part"), ((F.col("p_start") >= F.col("start")) & (F.col("p_end") <= stop)).alias("inside"))
    whole = touched.filter("inside").select("doc_id", "k", "p_start", "n", "clean", F.col("part").alias("text"))
    joined = touched.filter("not inside").groupBy("doc_id", "k", "p_start", "n", "clean").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("range_no", "part"))), lambda s: s["part"]), "").alias("text"))
    whole = whole.unionByName(joined)

    def emit(batches):
        encode, _ = _tools(folder)

        def halves(s, txt):
            n = len(encode(txt))
            if n <= limit or len(txt) < 2:
                return [(s, txt, n)]
            m = len(txt) // 2
            again = m - min(m // 2, len(txt) * overlap // n)
            return halves(s, txt[:m]) + halves(s + again, txt[again:])

        for b in batches:
            rows = [(i, k, sub, s, n, t) for i, k, s0, txt in zip(b.doc_id, b.k, b.p_start, b.text, strict=True) for sub, (s, t, n) in enumerate(halves(s0, txt))]
            yield pd.DataFrame(rows, columns=["doc_id", "k", "sub", "p_start", "n", "text"])

    again = cut(whole.filter("not clean").mapInPandas(emit, f"doc_id {kind}, k long, sub int, p_start long, n long, text string"))
    out = whole.filter("clean").select("doc_id", "k", F.lit(0).alias("sub"), "p_start", "n", "text").unionByName(again)
    extra = again.filter("sub > 0").groupBy("doc_id", "k").agg(F.count("*").alias("more"))
    number = F.col("k") - 1
    if extra.limit(1).count():  # halved pieces shift the numbers of those after them: counted on rows of a few numbers
        shift = p.join(extra, ["doc_id", "k"], "left").select("doc_id", "k", F.coalesce(F.sum("more").over(Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
        out, number = out.join(shift, ["doc_id", "k"]), number + F.col("shift") + F.col("sub")
    return out.select("doc_id", number.cast("int").alias("piece_no"), F.col("p_start").alias("start"), (F.col("p_start") + F.length("text")).alias("end"), F.col("n").alias("n_tokens"), "text")
