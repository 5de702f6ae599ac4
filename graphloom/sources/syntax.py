"""Symbols and calls of languages with brackets, from tokens (``sources.lexer``), as Spark windows and joins.

A token lies in the block of the bracket around it. Seen from a block, what nested brackets hold is
left out, so a definition is a short run of siblings: ``function name ( ) { }``. The siblings of a block are
written as one string, in which each token carries its place, and patterns find the heads of
definitions in it. A head counts at the top of a file, in the body of a class, and in scopes that are no symbols
themselves (namespaces, ``impl``). Definitions may go over any number of lines.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import written

_AT = r"§[\d:]+¶? "  # the place of a token: its number, line, end line, start and end; ¶ if it is first on its line
_HOLD = r"§([\d:]+)¶? "
_ID = r"(?![\d\"])[\p{L}\p{N}_$#]+"
_NAME = rf"({_ID}){_AT}"
_GENERIC = rf"(?:<{_AT}(?:(?![;{{}}])\S+ )*?>{_AT})?"
_PARAMS = rf"\({_HOLD}\){_HOLD}"
_BODY = rf"\{{{_HOLD}\}}{_HOLD}(?![{{,>&|\[]§)"
_ANCHORS = (
    r"(?:^|(?<=[;}]§[\d:]{1,60}¶{0,1} ))",  # after a member
    r"(?:^|(?<=[;}:]§[\d:]{1,60}¶{0,1} ))",  # or a label
    r"(?:^|(?<=[;}]§[\d:]{1,60}¶{0,1} )|(?=\S+¶ ))",  # or first on a line
)
_START, _LABELLED, _MEMBERS = _ANCHORS
_CLASS_BODY = rf"\{{{_HOLD}\}}{_HOLD}(?![,>&|\[]§)"


def _t(words: str) -> str:
    return rf"(?:{words}){_AT}"


def _up_to(stop: str) -> str:
    return rf"(?:(?!{stop})\S+ )*?"


class Head(NamedTuple):
    """A pattern for siblings: families, class, function or scope, whether it stands in classes only (None: anywhere), and
    the pattern. Its groups are named by ``groups``: s head words, n name, p and q the parameters' brackets, b and e those of the
    body, x what a class extends, t a subtype, y what a function returns, r and u a receiver's brackets."""

    families: tuple[str, ...]
    kind: str
    inside: bool | None
    groups: str
    pattern: str


_TS, _GO, _C = ("typescript",), ("go",), ("c", "cpp")
_MEMBER = _t(r"public|private|protected|static|async|override|get|set|abstract|readonly|declare|accessor|\*|@[\w.]+")
_MODS = rf"(?:{_t('public|private|protected|internal|fileprivate|open|abstract|final|static|sealed|partial|virtual|override|async|readonly|data|inline|suspend|operator|enum|annotation|inner|unsafe|extern|synchronized|native|default|strictfp|non|mutating|required|convenience|lateinit|new|class(?= *func)|pub|const|var|actual|expect|tailrec|infix|external|companion|indirect|nonisolated')}|@\S+ (?:\({_AT}\){_AT})?|\[{_AT}\]{_AT}|#{_AT}\[{_AT}\]{_AT})*"
_VALUE = rf"(?:\{{{_HOLD}\}}{_HOLD}|{_up_to(';§')}(?=;§|$|[^.?:&|+*/=)\]}}-]\S*¶ ))"
_RESULT = rf"((?::{_AT}{_up_to(';§')})?)"
_BASES = rf"((?:(?![{{;])\S+ |\{{{_AT}\}}{_AT}(?=[,>&|\[]))*?)"
_TYPE = rf"(?:(?!(?:new|return|throw|else|case|await|yield|using|package|import|goto|delete|if|for|while|switch|catch|do|try|class|struct|enum|interface|namespace|record)§)(?:[\p{{L}}_$][\p{{L}}\p{{N}}_$]*|[*&<>,.?]|::|\[|\]){_AT})"

HEADS = [
    Head(_TS, "function", False, "snpqybe", rf"((?:async{_AT})?function{_AT}(?:\*{_AT})?){_NAME}{_GENERIC}{_PARAMS}{_RESULT}{_BODY}"),
    Head(_TS, "class", False, "snxbe", rf"((?:abstract{_AT})?class{_AT}){_NAME}{_BASES}{_CLASS_BODY}"),
    Head(_TS, "class", False, "stnxbe", rf"((?:declare{_AT})?)(interface|enum){_AT}{_NAME}{_BASES}{_CLASS_BODY}"),
    Head(_TS, "function", False, "snpqybe", rf"((?:const|let){_AT}){_NAME}(?::{_AT}{_up_to('=§')})?={_AT}(?:async{_AT})?{_GENERIC}(?:{_PARAMS}{_RESULT}|{_ID}{_AT})=>{_AT}{_VALUE}"),
    Head(_TS, "function", False, "snpqybe", rf"((?:const|let){_AT}){_NAME}={_AT}(?:async{_AT})?function{_AT}(?:\*{_AT})?(?:{_ID}{_AT})?{_PARAMS}{_RESULT}{_BODY}"),
    Head(_TS, "class", False, "snxbe", rf"((?:const|let){_AT}){_NAME}={_AT}class{_AT}{_BASES}{_CLASS_BODY}"),
    Head(_TS, "function", True, "snpqybe", rf"{_MEMBERS}((?:{_MEMBER}(?:\({_AT}\){_AT})?)*){_NAME}{_GENERIC}{_PARAMS}{_RESULT}{_BODY}"),
    Head(_TS, "function", True, "sn", rf"{_MEMBERS}((?:{_MEMBER})*){_NAME}(?:[?!]{_AT})?(?:(?::|=){_AT}{_up_to(';§|[^.?:&|+*/=)-]+[^ ]*¶ ')})?(?:;{_AT}|(?=$|\S+¶ ))"),
    Head(_GO, "function", False, "snpqybe", rf"(func{_AT}){_NAME}(?:\[{_AT}\]{_AT})?{_PARAMS}({_up_to(';§|func§')}){_BODY}"),
    Head(_GO, "function", False, "srunpqybe", rf"(func{_AT}){_PARAMS}{_NAME}{_PARAMS}({_up_to(';§|func§')}){_BODY}"),
    Head(_GO, "class", False, "sntbe", rf"(type{_AT}){_NAME}(?:\[{_AT}\]{_AT})?(struct|interface){_AT}\{{{_HOLD}\}}{_HOLD}"),
    Head(_GO, "function", True, "snpq", rf"((?=\S+¶ )){_NAME}{_PARAMS}{_up_to('[^ ]+¶ ')}(?=$|[^ ]+¶ )"),
    Head(("java", "csharp"), "class", None, "stnxbe", rf"({_MODS})(class|interface|enum|record|struct|@interface){_AT}{_NAME}{_BASES}{_CLASS_BODY}"),
    Head(("java", "csharp"), "scope", False, "snbe", rf"(namespace{_AT}){_NAME}(?:\.{_AT}{_ID}{_AT})*\{{{_HOLD}\}}{_HOLD}"),
    Head(("java", "csharp"), "function", True, "snpqbe", rf"{_START}({_MODS}{_GENERIC}{_TYPE}*){_NAME}{_GENERIC}{_PARAMS}(?:(?:throws|where|:|base|this){_AT}{_up_to(';§')})?{_BODY}"),
    Head(("java", "csharp"), "function", True, "snpq", rf"{_START}({_MODS}{_GENERIC}{_TYPE}+){_NAME}{_GENERIC}{_PARAMS}(?:(?:throws|=>|where){_AT}{_up_to(';§')})?;{_AT}"),
    Head(("kotlin",), "class", None, "stnxbe", rf"({_MODS})(class|interface|object){_AT}{_NAME}{_GENERIC}((?:(?!\{{|;|[^)]\S*¶ )\S+ )*)(?:\{{{_HOLD}\}}{_HOLD})?"),
    Head(("kotlin",), "function", None, "snpqbe", rf"({_MODS}fun{_AT}){_GENERIC}(?:{_ID}{_AT}\.{_AT})?{_NAME}{_PARAMS}(?::{_AT}{_up_to('[={]§|[^ ]+¶ ')}(?=[={{;]§|$|\S+¶ ))?(?:={_AT}{_up_to(';§|[^.?:&|+*/=)-]+[^ ]*¶ ')}(?=;§|$|[^ ]+¶ )|\{{{_HOLD}\}}{_HOLD})?"),
    Head(("swift",), "class", None, "stnxbe", rf"({_MODS})(class|struct|enum|protocol|actor){_AT}(?!func§){_NAME}{_BASES}{_CLASS_BODY}"),
    Head(("swift",), "scope", False, "snbe", rf"({_MODS}extension{_AT}){_NAME}{_up_to('[{;]§')}\{{{_HOLD}\}}{_HOLD}"),
    Head(("swift",), "function", None, "snpqbe", rf"({_MODS}func{_AT}){_NAME}{_GENERIC}{_PARAMS}(?:(?:throws|rethrows|async){_AT})*(?:->{_AT}{_up_to('[{;]§|[^ ]+¶ ')}(?=[{{;]§|$|\S+¶ ))?(?:\{{{_HOLD}\}}{_HOLD})?"),
    Head(("rust",), "class", None, "stnbe", rf"({_MODS}(?:\({_AT}\){_AT})?)(struct|enum|trait|union){_AT}{_NAME}{_up_to('[{;]§')}(?:\{{{_HOLD}\}}{_HOLD}|;{_AT})"),
    Head(("rust",), "scope", None, "snbe", rf"((?:impl|mod){_AT}){_GENERIC}{_NAME}{_up_to('[{;]§')}\{{{_HOLD}\}}{_HOLD}"),
    Head(("rust",), "function", None, "snpqbe", rf"({_MODS}(?:\({_AT}\){_AT})?(?:(?:async|const|unsafe){_AT})*fn{_AT}){_NAME}{_GENERIC}{_PARAMS}{_up_to('[{;]§')}(?:\{{{_HOLD}\}}{_HOLD}|;{_AT})"),
    Head(("php",), "class", None, "stnxbe", rf"({_MODS})(class|interface|trait|enum){_AT}{_NAME}{_BASES}{_CLASS_BODY}"),
    Head(("php",), "scope", False, "snbe", rf"(namespace{_AT}){_NAME}{_up_to('[{;]§')}\{{{_HOLD}\}}{_HOLD}"),
    Head(("php",), "function", None, "snpqbe", rf"({_MODS}function{_AT}(?:&{_AT})?){_NAME}{_PARAMS}{_up_to('[{;]§')}(?:\{{{_HOLD}\}}{_HOLD}|;{_AT})"),
    Head(_C, "class", None, "stnxbe", rf"((?:typedef{_AT})?)(class|struct|enum|union){_AT}(?:class{_AT})?{_NAME}((?:(?![;{{=(]§)\S+ )*?)\{{{_HOLD}\}}{_HOLD}"),
    Head(_C, "scope", None, "sbe", rf"((?:namespace|extern){_AT}(?:[\w:\"]+{_AT})*)\{{{_HOLD}\}}{_HOLD}"),
    Head(_C, "function", None, "snpqbe", rf"{_LABELLED}((?:template{_AT}{_GENERIC})?(?:{_TYPE}|~{_AT})*?){_NAME}{_PARAMS}(?:(?:const|noexcept|override|final|volatile){_AT})*(?:(?:->|:){_AT}{_up_to(';§')})?{_BODY}"),
]
#: Words before brackets that name no definition and no call.
NO_NAMES = (
    "if", "for", "while", "switch", "catch", "return", "function", "else", "do", "try", "new", "sizeof", "typeof", "await", "yield", "throw", "import", "super", "case", "void", "in", "of", "delete", "extends", "implements",
)
GO_NO_NAMES = ("if", "for", "switch", "return", "else", "func", "select", "range", "case", "defer", "go", "map", "chan", "interface", "struct")


def no_name(name: Column) -> Column:
    return F.when(F.col("family") == "go", name.isin(*GO_NO_NAMES)).otherwise(name.isin(*NO_NAMES))


def in_blocks(tokens: DataFrame) -> DataFrame:
    """tokens with opener, the number of the bracket around each (-1 at the top). A bracket and what closes it are siblings."""
    order = Window.partitionBy("file_id").orderBy("n")
    # brackets that close nothing lower the ground
    rows = tokens.withColumn("_after", F.sum("sign").over(order))
    rows = rows.withColumn("depth", F.col("_after") - F.least(F.min("_after").over(order), F.lit(0)) - F.when(F.col("sign") > 0, 1).otherwise(0)).drop("_after")
    # a token right after an opening bracket begins a block, unless it closes the bracket
    begins = (F.lag("sign").over(order) > 0) & (F.col("sign") >= 0)
    rows = rows.withColumn("_block", F.when(begins, F.col("n") - 1))
    inside = Window.partitionBy("file_id", "depth").orderBy("n")
    found = F.coalesce(F.last("_block", ignorenulls=True).over(inside), F.lit(-1))
    return rows.withColumn("opener", F.when(F.col("depth") <= 0, -1).otherwise(found)).drop("_block")


def _place(mark: Column, i: int) -> Column:
    return F.try_element_at(F.split(mark, ":"), F.lit(i)).try_cast("int")


def siblings(rows: DataFrame) -> DataFrame:
    """file_id, family, opener and the siblings of each block as one string."""
    mark = F.concat_ws(":", "n", "line", "end_line", "start", "end")
    one = F.concat(F.regexp_replace("text", r"[\s§¶]", ""), F.lit("§"), mark, F.when(F.col("first"), "¶").otherwise(""))
    listed = rows.groupBy("file_id", "family", "opener").agg(F.array_sort(F.collect_list(F.struct("n", one.alias("t")))).alias("ts"))
    return listed.select("file_id", "family", "opener", F.concat(F.array_join(F.transform("ts", lambda x: x["t"]), " "), F.lit(" ")).alias("said"))


def _heads(blocks: DataFrame) -> DataFrame:
    """All heads in all blocks: file_id, family, opener, kind, inside and the parts of the head."""
    parts = []
    for head in HEADS:
        found = blocks.where(F.col("family").isin(*head.families)).select("file_id", "family", "opener", F.explode(F.regexp_extract_all("said", F.lit(head.pattern), F.lit(0))).alias("m"))
        group = lambda g: F.regexp_extract("m", head.pattern, head.groups.index(g) + 1) if g in head.groups else F.lit("")  # noqa: B023, E731
        # what stands before a head is not part of what is matched, so anchors to it go
        for anchor in _ANCHORS:
            head = head._replace(pattern=head.pattern.replace(anchor, ""))
        parts.append(found.select("file_id", "family", "opener", F.lit(head.kind).alias("kind"), F.lit(head.inside).cast("boolean").alias("inside"), "m", *[group(g).alias(g) for g in "sntpqbexryu"]))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    first, last = F.regexp_extract("m", r"§([\d:]+)", 1), F.regexp_extract("m", r"§([\d:]+)¶? $", 1)
    close = F.when(F.col("e") != "", F.col("e")).otherwise(last)
    destroys = (F.col("family") == "cpp") & F.col("s").rlike(r"~§\S+ $")
    y0, y1 = F.regexp_extract("y", r"^\S+?§([\d:]+)", 1), F.regexp_extract("y", r"§([\d:]+)¶? $", 1)
    return every.where(~no_name(F.col("n"))).select(
        "file_id", "family", "opener", "kind", "inside", F.when(destroys, F.concat(F.lit("~"), "n")).otherwise(F.col("n")).alias("name"), "t", "x", _place(y0, 4).alias("y0"), _place(y1, 5).alias("y1"), _place(first, 1).alias("at"), _place(first, 2).alias("start_line"), _place(close, 3).alias("end_line"), _place(first, 4).alias("_from"),
        _place(F.col("b"), 1).alias("body"), _place(F.col("e"), 1).alias("body_end"), _place(F.col("p"), 4).alias("p0"), _place(F.col("q"), 5).alias("p1"), _place(F.col("p"), 1).alias("params"), _place(F.col("r"), 1).alias("receiver"),
    )


def _ruby_heads(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Ruby's opening words are brackets: the name is what the block begins with."""
    order = Window.partitionBy("file_id", "opener").orderBy("n")
    opens = rows.where("family = 'ruby'").withColumn("_end", F.lead("end_line").over(order)).withColumn("_close", F.lead("n").over(order)).where("kind = 'open' and text in ('class', 'module', 'def')")
    named = rf"^(?:self{_AT}\.{_AT})?(?:{_ID}{_AT}::{_AT})*([\p{{L}}_][\p{{L}}\p{{N}}_]*[?!]?){_AT}"
    inner = blocks.where("family = 'ruby'").select("file_id", F.col("opener").alias("n"), "said")
    found = opens.join(inner, ["file_id", "n"])
    params = named + _PARAMS
    base = F.regexp_extract("said", rf"{named}<{_AT}((?:(?:{_ID}|::){_AT})+?)(?=$|\S+¶ )", 2)
    got = lambda i, k: _place(F.regexp_extract("said", params, i), k)
    return found.select(
        "file_id", "family", "opener", F.when(F.col("text") == "def", "function").otherwise("class").alias("kind"), F.lit(None).cast("boolean").alias("inside"), F.regexp_extract("said", named, 1).alias("name"),
        F.when(F.col("text") == "module", "module").otherwise("").alias("t"), F.concat(F.lit("extends§0 "), base).alias("x"), *[F.lit(None).cast("int").alias(c) for c in ("y0", "y1")], F.col("n").alias("at"), F.col("line").alias("start_line"), F.col("_end").alias("end_line"), F.col("start").alias("_from"),
        F.col("n").alias("body"), F.col("_close").alias("body_end"), got(2, 4).alias("p0"), got(3, 5).alias("p1"), got(2, 1).alias("params"), F.lit(None).cast("int").alias("receiver"),
    ).where("name <> ''")


def _bases(text: Column) -> Column:
    """Names in a list of what a class extends: the last part of each, without what is in brackets."""
    plain = text
    for _ in range(3):
        plain = F.regexp_replace(plain, r"< [^<>]*>|\( [^()]*\)", "")
    plain = F.regexp_replace(plain, r"\b(?:public|protected|private|virtual)\b", "")
    return F.filter(F.transform(F.split(plain, ","), lambda x: F.replace(F.trim(x), F.lit(" "), F.lit(""))), lambda x: x != "")


def _heritage(name: str) -> Column:
    """The superclasses or interfaces of a class head."""
    plain = F.regexp_replace("x", r"§[\d:]+¶?", "")
    extends = F.regexp_extract(plain, r"\bextends (.*?)(?:\bimplements |\bpermits |$)", 1)
    implements = F.regexp_extract(plain, r"\bimplements (.*?)(?:\bextends |\bpermits |$)", 1)
    colon = F.regexp_extract(plain, r"(?:^|\s):\s(.*)$", 1)
    worded = F.col("family").isin("typescript", "java", "php", "ruby")
    found = _bases(F.when(worded, extends).otherwise(colon)) if name == "superclasses" else _bases(F.when(worded, implements).otherwise(""))
    return F.when(F.size(found) > 0, found)


def _clean_doc(doc: Column) -> Column:
    text = F.regexp_replace(doc, r"(?m)^\s*(?:/\*\*?|\*/|///?!?|\*(?!/)|#+)[ \t]?", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\s*\*+/\s*$", ""), r"(?m)^[ \t]+|[ \t]+$", "")
    return F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))


def _parameters(rows: DataFrame, heads: DataFrame, sources: DataFrame) -> DataFrame:
    """file_id, params and type_signature: types of parameters in brackets, for TypeScript and Go."""
    asked = heads.where("params is not null and family in ('typescript', 'go')").select("file_id", F.col("params").alias("opener")).distinct()
    order = Window.partitionBy("file_id", "opener").orderBy("n")
    inner = rows.join(asked, ["file_id", "opener"], "left_semi").withColumn("seg", F.sum((F.col("text") == ",").cast("int")).over(order)).where("text <> ','")
    inner = inner.withColumn("_i", F.row_number().over(Window.partitionBy("file_id", "opener", "seg").orderBy("n")))
    colon = F.min(F.when(F.col("text") == ":", F.col("start"))).alias("colon")
    equals = F.min(F.when(F.col("text") == "=", F.col("start"))).alias("equals")
    per = inner.groupBy("file_id", "family", "opener", "seg").agg(colon, equals, F.min("start").alias("a"), F.max("end").alias("b"), F.min(F.when(F.col("_i") == 2, F.col("start"))).alias("second"), F.min(F.struct("n", "text", "kind")).alias("f"), F.min(F.when(F.col("_i") == 2, F.col("text"))).alias("text2"))
    per = per.join(sources.select("file_id", "content"), "file_id")
    cut = lambda a, b: F.col("content").substr(a + 1, b - a)
    leaf = lambda t: F.when(t.contains("."), F.substring_index(t, ".", -1)).otherwise(t)
    script = F.when(F.col("colon").isNotNull(), leaf(F.replace(cut(F.col("colon"), F.coalesce("equals", "b")), F.lit(" "), F.lit("")))).alias("type")
    rest = F.col("f.text") == "..."
    script_type = F.when(rest, F.concat(script, F.lit("[]"))).otherwise(script)
    # Go: if some parameter has a name and a type, names alone share the type of those after them
    named = (F.col("f.kind") == "name") & F.col("second").isNotNull() & ~F.coalesce(F.col("text2").isin(".", "["), F.lit(False)) & ~F.col("f.text").isin("map", "chan", "func", "interface", "struct")
    named = named | ((F.col("f.kind") == "name") & (F.col("text2") == "[") & ~F.col("f.text").isin("map"))
    per = per.withColumn("_named", named)
    whole = Window.partitionBy("file_id", "opener")
    per = per.withColumn("_any", F.max(F.col("_named")).over(whole))
    raw = F.when(F.col("_named"), cut(F.col("second"), F.col("b"))).when(~F.col("_any"), cut(F.col("a"), F.col("b")))
    nearest = F.last(raw, ignorenulls=True).over(whole.orderBy(F.col("seg").desc()).rowsBetween(Window.unboundedPreceding, 0))
    per = per.withColumn("_type", F.when(F.col("family") == "go", go_type(nearest)).otherwise(script_type))
    listed = per.groupBy("file_id", "family", F.col("opener").alias("params")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seg", "_type"))), lambda x: x["_type"]).alias("ts"))
    return listed.select("file_id", "params", F.when(~F.exists("ts", lambda x: x.isNull()), F.concat(F.lit("("), F.array_join("ts", ","), F.lit(")"))).alias("type_signature"))


def go_type(text: Column) -> Column:
    """A Go type as written to its short form: no pointers, ``[]`` behind, the last part of a qualified name."""
    plain = F.regexp_replace(F.trim(text), r"^\*+", "")
    dots = plain.startswith("...")
    plain = F.regexp_replace(plain, r"^\.\.\.\s*\*?", "")
    slices = F.length(F.regexp_extract(plain, r"^((?:\[\]\*?)*)", 1))
    depth = (F.length(F.replace(F.regexp_extract(plain, r"^((?:\[\]\*?)*)", 1), F.lit("*"), F.lit(""))) / 2).cast("int")
    inner = F.regexp_replace(plain, r"^(?:\[\]\*?)+", "")
    short = F.when(inner.rlike(r"^\w+\.\w+$"), F.substring_index(inner, ".", -1)).otherwise(inner)
    return F.concat(F.when(slices > 0, F.concat(short, F.repeat(F.lit("[]"), depth))).otherwise(short), F.when(dots, "...").otherwise(""))


def _returned() -> Column:
    """What a function returns: in TypeScript as written without spaces, in Go by go_type, without names."""
    text = F.when(F.col("y0").isNotNull(), F.col("content").substr(F.col("y0") + 1, F.col("y1") - F.col("y0")))
    flat = F.replace(text, F.lit(" "), F.lit(""))
    script = F.when(flat.contains("."), F.substring_index(flat, ".", -1)).otherwise(flat)
    listed = F.regexp_extract(text, r"(?s)^\((.*?),?\s*\)$", 1)
    parts = F.filter(F.transform(F.split(listed, ","), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    typed = r"^[\p{L}_][\p{L}\p{N}_]*\s+[^\s].*$"
    named = F.exists(parts, lambda p: p.rlike(typed) & ~p.rlike(r"^(?:map|chan|func|interface|struct)\b"))
    types = F.when(named, F.transform(F.filter(parts, lambda p: p.rlike(typed)), lambda p: F.regexp_replace(p, r"^\S+\s+", ""))).otherwise(parts)
    short = F.transform(types, go_type)
    several = F.when(F.size(short) == 1, F.element_at(short, 1)).when(F.size(short) > 1, F.concat(F.lit("("), F.array_join(short, ","), F.lit(")")))
    return F.when(F.col("family") == "go", F.when(text.startswith("("), several).otherwise(go_type(text))).otherwise(F.when(F.col("family") == "typescript", script))


def symbols(sources: DataFrame, rows: DataFrame) -> DataFrame:
    """file_id, family, seq, parent (seq of the class around, or null), scope, name, kind, subtype, start_line, end_line, signature, type_signature,
    docs, superclasses, interfaces, receiver_var, receiver_type, body and body_end (tokens) of files (file_id, language, content); ``rows`` are in_blocks(tokens)."""
    said = written(siblings(rows), "siblings")
    heads = written(_heads(said).unionByName(_ruby_heads(rows, said)), "heads")
    heads = heads.withColumn("_n", F.row_number().over(Window.partitionBy("file_id", "opener", "at").orderBy(F.col("kind") == "scope", F.col("body").isNull(), F.col("p0").isNull()))).where("_n = 1").drop("_n")
    top = heads.where("opener = -1 and (inside is null or not inside)").select("*", F.array().cast("array<struct<at:int,name:string>>").alias("path"), F.lit(False).alias("_in"))
    kept, level = [top], top
    while True:
        bodies = level.where("kind in ('class', 'scope') and body is not null and not (family = 'typescript' and t in ('interface', 'enum'))")
        holders = bodies.select(
            "file_id", F.col("body").alias("opener"), F.when(F.col("kind") == "class", F.concat("path", F.array(F.struct(F.col("at"), F.col("name"))))).otherwise(F.col("path")).alias("path"), (F.col("kind") == "class").alias("_in")
        )
        level = written(heads.join(holders, ["file_id", "opener"]).where("inside is null or inside = _in").select(top.columns), "heads-inside")
        if level.isEmpty():
            break
        kept.append(level)
    found = kept[0]
    for part in kept[1:]:
        found = found.unionByName(part)
    found = found.where("kind <> 'scope'").join(sources.select("file_id", "content"), "file_id")
    docs = rows.where("doc is not null").select("file_id", F.col("n").alias("at"), "doc")
    # an exported or annotated definition's comment stands before the first word of its statement
    shifted = rows.withColumn("_back", F.lag("doc").over(Window.partitionBy("file_id").orderBy("n"))).where("text not in (';', '{', '}')").select("file_id", F.col("n").alias("at"), "_back", F.lag("text").over(Window.partitionBy("file_id").orderBy("n")).alias("_word")).where("_back is not null and _word in ('export', 'default')").select("file_id", "at", "_back")
    found = found.join(docs, ["file_id", "at"], "left").join(shifted, ["file_id", "at"], "left").join(_parameters(rows, heads, sources), ["file_id", "params"], "left")
    text = F.when(F.col("p0").isNotNull(), F.col("content").substr(F.col("p0") + 1, F.col("p1") - F.col("p0")))
    heard = _receivers(rows, heads)
    found = found.join(heard, ["file_id", "receiver"], "left").join(_embedded(said), ["file_id", "body"], "left")
    own = F.row_number().over(Window.partitionBy("file_id").orderBy("at"))
    is_class = F.col("kind") == "class"
    goes = F.col("family") == "go"
    struct = F.col("t") == "struct"
    subtype = F.when(is_class & (F.col("t") != "class"), F.nullif(F.col("t"), F.lit("")))
    types = F.when(F.col("family").isin("typescript", "go") & F.col("p0").isNotNull(), F.when(F.col("p1") - F.col("p0") == 2, F.lit("()")).otherwise(F.col("type_signature")))
    listed = found.select(
        "file_id", "family", own.alias("seq"), "at", F.try_element_at("path", F.lit(-1))["at"].alias("_parent"), F.concat_ws("::", "file_id", F.transform("path", lambda x: x["name"])).alias("scope"), "name", "kind", subtype.alias("subtype"),
        "start_line", "end_line", F.when(~is_class, text).alias("signature"), F.when(~is_class, types).alias("type_signature"), _returned().alias("return_type"), _clean_doc(F.coalesce("doc", "_back")).alias("docs"),
        F.when(is_class, F.when(goes, F.when(struct, F.col("embedded"))).otherwise(_heritage("superclasses"))).alias("superclasses"), F.when(is_class, F.when(goes, F.when(~struct, F.col("embedded"))).otherwise(_heritage("interfaces"))).alias("interfaces"),
        "receiver_var", "receiver_type", "body", "body_end",
    )
    above = listed.select("file_id", F.col("at").alias("_parent"), F.col("seq").alias("parent"))
    return listed.join(above, ["file_id", "_parent"], "left").drop("_parent", "at")


def _receivers(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """file_id, receiver (a bracket), receiver_var, receiver_type of Go's methods."""
    asked = heads.where("receiver is not null").select("file_id", F.col("receiver").alias("opener"))
    names = rows.join(asked, ["file_id", "opener"], "left_semi").where("kind = 'name'").groupBy("file_id", F.col("opener").alias("receiver")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("ws"))
    return names.select("file_id", "receiver", F.when(F.size("ws") > 1, F.element_at("ws", 1)).alias("receiver_var"), F.try_element_at("ws", F.least(F.size("ws"), F.lit(2))).alias("receiver_type"))


def _embedded(said: DataFrame) -> DataFrame:
    """file_id, body, embedded: types that stand alone on a line of a Go struct or interface."""
    line = rf"(?:(?:^|(?<= ))\*§[\d:]+¶ ({_ID}(?:§[\d:]+ \.§[\d:]+ {_ID})?)§[\d:]+ |(?:^|(?<= ))({_ID}(?:§[\d:]+¶ \.§[\d:]+ {_ID}§[\d:]+ |§[\d:]+¶ )))(?:\"§[\d:]+ )?(?=$|\S+¶ )"
    found = said.where("family = 'go'").select("file_id", F.col("opener").alias("body"), F.regexp_extract_all("said", F.lit(line), F.lit(0)).alias("ms")).where(F.size("ms") > 0)
    clean = F.transform("ms", lambda m: F.regexp_replace(F.regexp_replace(m, r"§[\d:]+¶? ", ""), r"[*\"]", ""))
    return found.select("file_id", "body", clean.alias("embedded"))


def calls(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """file_id, caller (seq), ord, name, receiver, kind: calls of TypeScript and Go in the bodies of functions, in the order of the called names' brackets. A
    receiver is the chain before the last dot as places in the text: start and end."""
    code = rows.where("family in ('typescript', 'go')")
    order = Window.partitionBy("file_id", "opener").orderBy("n")
    prev = lambda c, k=1: F.lag(c, k).over(order)
    code = code.select("*", prev("text").alias("p1"), prev("kind").alias("k1"), prev("text", 2).alias("p2"), F.lead("text", 2).over(order).alias("after"), prev("end", 2).alias("e2"))
    joins = F.col("text").isin(".", "?.") | F.col("p1").isin(".", "?.", "new") | (F.col("kind") == "close") | (F.col("text").isin("(", "[") & (F.col("k1").isin("close", "string") | ((F.col("k1") == "name") & ~no_name(F.col("p1"))))) | ((F.col("text") == "!") & F.col("k1").isin("name", "close"))
    code = code.withColumn("_from", F.last(F.when(~F.coalesce(joins, F.lit(False)), F.col("start")), ignorenulls=True).over(order))
    code = code.withColumns({"_name": F.col("p1"), "_chain": prev("_from"), "_recv_end": prev("end", 3), "_new": prev("text", 2) == "new", "_two": prev("text", 2)})
    hit = code.where((F.col("text") == "(") & (F.col("k1") == "name") & ~no_name(F.col("p1")))
    hit = hit.where(F.coalesce(~F.col("_two").isin("new", "function", "func", "*"), F.lit(True)) & ~((F.col("family") == "typescript") & F.coalesce(F.col("after") == "{", F.lit(False))))
    attribute = F.coalesce(F.col("_two").isin(".", "?."), F.lit(False))
    hit = hit.select("file_id", "n", F.col("_name").alias("name"), F.when(attribute, F.col("_chain")).alias("a"), F.when(attribute, F.col("_recv_end")).alias("b"), F.when(attribute, "attribute").otherwise("bare").alias("kind"))
    bodies = symbols.where("kind = 'function' and body is not null").select("file_id", F.col("seq").alias("caller"), "body", "body_end")
    return hit.join(bodies, "file_id").where("n > body and n < body_end").select("file_id", "caller", F.col("n").alias("ord"), "name", "a", "b", "kind")


def call_refs(sources: DataFrame, rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls with the receiver's text."""
    found = calls(rows, symbols).join(sources.select("file_id", "content"), "file_id")
    return found.select("file_id", "caller", "ord", "name", F.when(F.col("a").isNotNull(), F.col("content").substr(F.col("a") + 1, F.col("b") - F.col("a"))).alias("receiver"), "kind")
