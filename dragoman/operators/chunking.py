"""Document chunking inside the row.

A document is one row, so splitting, classifying and packing its lines needs no shuffle: each step is
an array function over the row. The packers are folds whose state holds the finished chunks and the
open one; the chunk array is copied only when a chunk closes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dragoman.functions import dims
from dragoman.functions import text as X
from dragoman.operators.scale import explode_rows

# Line and sentence patterns.
PARAGRAPH = "(?U)\\n\\s*\\n+"
LINE_END = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"
HEADING = (
    "(?U)^(?:(?:القسم|الفصل|المادة|البند|أولاً|ثانياً|ثالثاً|رابعاً|خامساً|أ\\.|ب\\.|ج\\.|د\\.)\\s*.+"
    "|(?:Chapter|Section|Article|Part|Appendix)\\s+\\w+"
    "|(?:\\d+\\.)+\\s+\\S.{0,60}"
    "|[A-Z][A-Z\\s]{4,50}$)"
)
NOISE = (
    "(?iU)^(?:\\d+\\s*$|[|·•\\-–—=_]{3,}|(?:home|menu|search|login|contact|sitemap|copyright|©)"
    "|(?:الرئيسية|القائمة|بحث|دخول|اتصل|خريطة الموقع))\\s*$"
)
LIST_ITEM = "(?U)^\\s*(?:[-•*·◦▪▸]\\s+\\S|\\d+[.)]\\s+\\S|[\\u0661-\\u0669][.)]\\s+\\S)"
OVERSIZED_BREAK = "(?U)(?<=[.!?؟؛])\\s+|(?<=\\n)\\s*(?=\\S)"
SENTENCE_BREAK = "(?U)(?<=[.!?؟؛])\\s+|(?<=။)\\s+|\\n+"


def break_start(reach: int) -> str:
    """Start of a sentence break: white space after a terminator, or the first line end of a run that no
    terminator precedes. ``reach`` is the length of the window the pattern looks at."""
    return f"(?:(?<=[.!?؟؛။])\\s|(?<!\\n)(?<![.!?؟؛။]\\s{{1,{reach}}})\\n)"



STRATEGIES = ("contextual", "structural", "char", "sentence", "semantic")
_NONE = "cast(null AS string)"
_EMPTY = "cast(array() AS array<string>)"


def is_heading(line: Column) -> Column:
    size = F.length(line)
    short = (size < 80) & ~line.rlike("[.،,;]$") & line.rlike("^[\\u0600-\\u06FFA-Z]")
    return (size > 0) & (size <= 120) & (line.rlike(HEADING) | short)


def clean_line(line: Column) -> Column:
    t = X.strip(F.regexp_replace(line, "[ \\t]+", " "))
    return F.when(t.rlike(NOISE), "").otherwise(t)


def _kind(line: Column, alone: Column) -> Column:
    return (
        F.when(is_heading(line), "heading")
        .when(~alone & line.rlike(LIST_ITEM), "list")
        .otherwise("paragraph")
    )


def with_blocks(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``blocks``: array of (kind, text), one per heading, list or paragraph run.

    Consecutive lines of a paragraph with the same kind form a run; list lines keep their line ends.
    """
    cleaned = F.transform(
        F.split(F.col(text), PARAGRAPH),
        lambda p: F.filter(F.transform(F.split(p, LINE_END), clean_line), lambda x: x != ""),
    )
    lines = F.flatten(
        F.transform(
            cleaned,
            lambda ls, i: F.transform(
                ls,
                lambda x: F.struct(
                    i.alias("para"), _kind(x, F.size(ls) == 1).alias("kind"), x.alias("line")
                ),
            ),
        )
    )
    out = df.withColumn("_lines", lines)
    n = F.size("_lines")
    starts = F.filter(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() AS array<int>)")),
        lambda i: (i == 0)
        | (F.get("_lines", i)["kind"] == "heading")
        | (F.get("_lines", i)["kind"] != F.get("_lines", i - 1)["kind"])
        | (F.get("_lines", i)["para"] != F.get("_lines", i - 1)["para"]),
    )
    out = out.withColumn("_starts", starts)
    runs = F.transform(
        "_starts",
        lambda s, j: F.slice("_lines", s + 1, F.coalesce(F.get("_starts", j + 1), F.size("_lines")) - s),
    )
    out = out.withColumn("_runs", runs)
    blocks = F.transform(
        "_runs",
        lambda r: F.struct(
            F.get(r, 0)["kind"].alias("kind"),
            F.when(F.get(r, 0)["kind"] == "list", F.array_join(F.transform(r, lambda x: x["line"]), "\n"))
            .otherwise(F.array_join(F.transform(r, lambda x: x["line"]), " "))
            .alias("text"),
        ),
    )
    return out.withColumn("blocks", blocks).drop("_lines", "_starts", "_runs")


def extract_blocks(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Block rows (id, pos, kind, text, heading); heading is the nearest one at or before the block."""
    at = F.filter(
        F.transform("blocks", lambda b, i: F.when((b["kind"] == "heading") | (i == 0), i)), lambda i: i.isNotNull()
    )

    def section(begin: Column, j: Column) -> Column:
        """Blocks from one heading to the next, all under that heading."""
        first = F.get("blocks", begin)
        head = F.when(first["kind"] == "heading", first["text"]).otherwise("")
        inside = F.slice("blocks", begin + 1, F.coalesce(F.get("_at", j + 1), F.size("blocks")) - begin)
        return F.transform(
            inside, lambda b: F.struct(b["kind"].alias("kind"), b["text"].alias("text"), head.alias("heading"))
        )

    # the heading is attached inside the array: columns used next to an explode are evaluated per row
    rows = with_blocks(df, text).withColumn("_at", at)
    rows = rows.select(id_col, F.flatten(F.transform("_at", section)).alias("_b"))
    return explode_rows(rows, "_b", "pos", "b").select(
        id_col, "pos", "b.kind", "b.text", "b.heading"
    )


def _sentences(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), X.strip), lambda s: s != "")


def _join(open_: Column, s: Column) -> Column:
    return F.when(open_.isNull(), s).otherwise(F.concat(open_, F.lit(" "), s))


def _close(out: Column, open_: Column, floor: int) -> Column:
    return F.when(F.length(open_) >= floor, F.array_append(out, open_)).otherwise(out)


def split_oversized(
    text: Column, max_size: int = dims.MAX_CHUNK, min_size: int = dims.MIN_CHUNK
) -> Column:
    """Sentences of one block grouped up to ``max_size``; parts under the floor go, and when nothing
    is left the block's first ``max_size`` characters stand for it."""
    start = F.struct(
        F.expr(_EMPTY).alias("out"), F.expr(_NONE).alias("open"), F.lit(0).alias("size")
    )

    def step(acc: Column, s: Column) -> Column:
        full = (acc["size"] + F.length(s) > max_size) & acc["open"].isNotNull()
        return F.struct(
            F.when(full, _close(acc["out"], acc["open"], min_size)).otherwise(acc["out"]).alias("out"),
            F.when(full, s).otherwise(_join(acc["open"], s)).alias("open"),
            F.when(full, F.length(s)).otherwise(acc["size"] + F.length(s)).alias("size"),
        )

    parts = F.aggregate(
        _sentences(text, OVERSIZED_BREAK), start, step,
        lambda acc: _close(acc["out"], acc["open"], min_size),
    )
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.substring(text, 1, max_size)))


def _assemble(target: int, max_size: int, min_size: int, inject: bool) -> Column:
    """Greedy packing of ``blocks``; headings close the open chunk and start a context."""
    parts = F.transform(
        "blocks",
        lambda b: F.struct(
            b["kind"].alias("kind"),
            b["text"].alias("text"),
            F.length(b["text"]).alias("size"),
            F.when(
                (b["kind"] != "heading") & (F.length(b["text"]) > max_size),
                split_oversized(b["text"], max_size, min_size),
            ).alias("parts"),
        ),
    )
    start = F.struct(
        F.expr(_EMPTY).alias("out"), F.expr(_NONE).alias("open"), F.lit(0).alias("size"),
        F.lit("").alias("head"),
    )

    def titled(body: Column, head: Column) -> Column:
        if not inject:
            return body
        plain = (head == "") | F.startswith(body, head)
        return F.when(plain, body).otherwise(F.concat(head, F.lit("\n"), body))

    def flush(out: Column, open_: Column, head: Column) -> Column:
        return F.when(
            F.length(open_) >= min_size, F.array_append(out, titled(open_, head))
        ).otherwise(out)

    def step(acc: Column, b: Column) -> Column:
        heading, big = b["kind"] == "heading", b["parts"].isNotNull()
        reset = heading | big
        fits = acc["size"] + b["size"] <= target
        # an open chunk under the floor is carried on, and only the new block counts from there
        over = ~fits & (acc["size"] >= min_size)
        closed = flush(acc["out"], acc["open"], acc["head"])
        out = (
            F.when(heading | (~big & over), closed)
            .when(big, F.concat(closed, F.transform(b["parts"], lambda p: titled(p, acc["head"]))))
            .otherwise(acc["out"])
        )
        open_ = F.when(over, b["text"]).otherwise(_join(acc["open"], b["text"]))
        size = F.when(fits, acc["size"] + b["size"]).otherwise(b["size"])
        ceiling = ~reset & (size >= max_size)
        return F.struct(
            F.when(ceiling, flush(out, open_, acc["head"])).otherwise(out).alias("out"),
            F.when(reset | ceiling, F.expr(_NONE)).otherwise(open_).alias("open"),
            F.when(reset | ceiling, 0).otherwise(size).alias("size"),
            F.when(heading, b["text"]).otherwise(acc["head"]).alias("head"),
        )

    return F.aggregate(parts, start, step, lambda a: flush(a["out"], a["open"], a["head"]))


def chunk_structural(
    df: DataFrame,
    text: str = "text",
    target: int = dims.TARGET_CHUNK,
    max_size: int = dims.MAX_CHUNK,
    min_size: int = dims.MIN_CHUNK,
    inject_heading: bool = False,
) -> DataFrame:
    """Add ``chunks`` packed from blocks."""
    packed = _assemble(target, max_size, min_size, inject_heading)
    return with_blocks(df, text).withColumn("chunks", packed).drop("blocks")


def chunk_contextual(df: DataFrame, text: str = "text", **sizes: int) -> DataFrame:
    """Structural chunks with their heading in front."""
    return chunk_structural(df, text, inject_heading=True, **sizes)


def chunk_sentence(text: Column, max_sentences: int = 5, min_sentences: int = 2) -> Column:
    """Groups of five sentences or 1000 characters; the tail needs two sentences."""
    start = F.struct(
        F.expr(_EMPTY).alias("out"), F.expr(_NONE).alias("open"), F.lit(0).alias("n"),
        F.lit(0).alias("size"),
    )

    def step(acc: Column, s: Column) -> Column:
        open_ = _join(acc["open"], s)
        full = (acc["n"] + 1 >= max_sentences) | (acc["size"] + F.length(s) >= 1000)
        return F.struct(
            F.when(full, _close(acc["out"], open_, dims.MIN_CHUNK)).otherwise(acc["out"]).alias("out"),
            F.when(full, F.expr(_NONE)).otherwise(open_).alias("open"),
            F.when(full, 0).otherwise(acc["n"] + 1).alias("n"),
            F.when(full, 0).otherwise(acc["size"] + F.length(s)).alias("size"),
        )

    return F.aggregate(
        _sentences(text, SENTENCE_BREAK), start, step,
        lambda a: F.when(a["n"] >= min_sentences, _close(a["out"], a["open"], dims.MIN_CHUNK)).otherwise(a["out"]),
    )


def chunk_semantic(
    text: Column, target: int = dims.TARGET_CHUNK, max_size: int = dims.MAX_CHUNK
) -> Column:
    """Sentences up to the target, closed early when the next would pass the maximum; only the tail
    has a floor."""
    start = F.struct(
        F.expr(_EMPTY).alias("out"), F.expr(_NONE).alias("open"), F.lit(0).alias("size")
    )

    def step(acc: Column, s: Column) -> Column:
        early = (acc["size"] + F.length(s) > max_size) & acc["open"].isNotNull()
        out = F.when(early, F.array_append(acc["out"], acc["open"])).otherwise(acc["out"])
        open_ = F.when(early, s).otherwise(_join(acc["open"], s))
        size = F.when(early, F.length(s)).otherwise(acc["size"] + F.length(s))
        full = size >= target
        return F.struct(
            F.when(full, F.array_append(out, open_)).otherwise(out).alias("out"),
            F.when(full, F.expr(_NONE)).otherwise(open_).alias("open"),
            F.when(full, 0).otherwise(size).alias("size"),
        )

    return F.aggregate(
        _sentences(text, SENTENCE_BREAK), start, step,
        lambda a: _close(a["out"], a["open"], dims.MIN_CHUNK),
    )


def chunk_char(
    text: Column, size: int = dims.TARGET_CHUNK, overlap: int = dims.CHAR_OVERLAP
) -> Column:
    """Fixed windows cut at the last sentence break in their final fifth.

    The start of a window depends on the cut before it, so the fold runs over a bounded number of
    steps; the overlap must stay under four fifths of the size or the windows would not advance.
    """
    tail = int(size * 0.8)
    if overlap >= tail:
        raise ValueError("overlap must be smaller than four fifths of the chunk size")
    n = F.length(text)
    steps = F.sequence(F.lit(1), F.ceil(n / (tail + 1 - overlap)).cast("int") + 1)
    start = F.struct(F.expr(_EMPTY).alias("out"), F.lit(0).alias("at"))
    head = break_start(size - tail)

    def folded(pages: Column) -> Column:
        def part(at: Column, length: Column) -> Column:
            # at most ``size`` characters, so two pages hold them wherever they begin
            page = F.floor(at / size).cast("int")
            two = F.concat(F.get(pages, page), F.coalesce(F.get(pages, page + 1), F.lit("")))
            return F.substring(two, (at - page * size + 1).cast("int"), length)

        def step(acc: Column, _: Column) -> Column:
            at = acc["at"]
            live = at < n
            window = F.when(at + tail < n, part(at + tail, F.lit(size - tail))).otherwise("")
            cut = (at + size < n) & window.rlike(head)
            before = F.length(F.regexp_extract(window, f"(?s)^(.*){head}", 1))
            end = at + F.when(cut, tail + before + 1).otherwise(size)
            piece = X.strip(part(at, (end - at).cast("int")))
            return F.struct(
                F.when(live, _close(acc["out"], piece, dims.MIN_CHUNK)).otherwise(acc["out"]).alias("out"),
                F.when(live, end - overlap).otherwise(at).alias("at"),
            )

        return F.aggregate(steps, start, step, lambda a: a["out"])

    # pages of fixed length: a window is found without walking the text from its start
    pages = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.get(F.transform(F.array(pages), folded), F.lit(0))


def chunk_document(
    df: DataFrame,
    strategy: str = "contextual",
    size: int = dims.TARGET_CHUNK,
    overlap: int = dims.CHAR_OVERLAP,
    text: str = "text",
) -> DataFrame:
    """Add ``chunks`` by strategy; blank text has none."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}, choose from {', '.join(STRATEGIES)}")
    if strategy in ("contextual", "structural"):
        out = chunk_structural(df, text, target=size, inject_heading=strategy == "contextual")
    else:
        t = F.col(text)
        chunks = {
            "char": lambda: chunk_char(t, size, overlap),
            "sentence": lambda: chunk_sentence(t),
            "semantic": lambda: chunk_semantic(t, size),
        }[strategy]()
        out = df.withColumn("chunks", chunks)
    blank = F.coalesce(X.strip(F.col(text)), F.lit("")) == ""
    return out.withColumn("chunks", F.when(blank, F.expr(_EMPTY)).otherwise(F.col("chunks")))


def chunk_corpus(
    df: DataFrame, strategy: str = "contextual", text: str = "text"
) -> DataFrame:
    """Corpus rule: short documents are cut structurally, and a document without any chunk that is
    long enough is one chunk itself."""
    size = F.length(text)
    short = size < dims.SHORT_DOC
    floor = F.when(short, dims.LENIENT_SHORT_MIN_CHARS).otherwise(dims.LENIENT_MIN_CHARS)
    if strategy in ("contextual", "structural"):
        # both packings share the blocks; the condition is evaluated before either fold runs
        blocks = with_blocks(df, text)
        args = dims.TARGET_CHUNK, dims.MAX_CHUNK, dims.MIN_CHUNK
        plain = _assemble(*args, False)
        chosen = _assemble(*args, strategy == "contextual")
        out = blocks.withColumn("chunks", F.when(short, plain).otherwise(chosen)).drop("blocks")
    else:
        long_part = chunk_document(df, strategy, text=text).withColumnRenamed("chunks", "_long")
        out = chunk_structural(long_part, text).withColumn(
            "chunks", F.when(short, F.col("chunks")).otherwise(F.col("_long"))
        ).drop("_long")
    whole = X.strip(F.col(text))
    fallback = F.when(F.length(whole) >= floor, F.array(whole)).otherwise(F.expr(_EMPTY))
    return out.withColumn(
        "chunks", F.when(F.size("chunks") > 0, F.col("chunks")).otherwise(fallback)
    ).withColumn("is_short_doc", short)


def sentence_table(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    s = df.select(id_col, _sentences(F.col(text), SENTENCE_BREAK).alias("s"))
    return explode_rows(s, "s", "pos", "sentence")


def chunk_rows(df: DataFrame, *columns: str) -> DataFrame:
    """One row per chunk with its index and the document's chunk count."""
    sized = df.select(*columns, F.size("chunks").alias("total_chunks"), "chunks")
    return explode_rows(sized, "chunks", "chunk_index", "text")
