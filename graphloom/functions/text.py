"""Text functions as Spark column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import fixed_values as fixed


def _longer(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: F.length(t) > 1)


def search_text(name: Column, kind: Column, properties: Column) -> Column:
    """What full-text search sees of a node: name, type, summary and path."""
    return F.concat_ws(" ", name, kind, F.get_json_object(properties, "$.summary"), F.get_json_object(properties, "$.path"))


#: The same matches as the fixed patterns, tried only where a run of letters begins and without going back.
_COMPOUND = "(?<![a-z])[a-z][a-z0-9]*+(?:-[a-z0-9]++)+"
_CAMEL = "(?<![a-z])[a-z][a-z0-9]*+(?:[A-Z][a-z0-9]*+)+"
#: What separates words of lower-cased text: all but a-z, 0-9 and _. Java tests a negated class of its own about six times slower.
_APART = r"\W+"
#: Tokens of one character, which are dropped.
_SINGLE = [*"abcdefghijklmnopqrstuvwxyz0123456789_", ""]


def tokenize(text: Column) -> Column:
    """Distinct search tokens, in order: hyphenated compounds with their parts, camel-case
    words with theirs, then the words that are left, without stop words. Only texts that have
    compounds or camel-case words are searched for them; for the others it is one split."""
    lower = F.lower(text)
    dropped = F.array(*[F.lit(w) for w in [*fixed.STOP_WORDS, *_SINGLE]])
    words = lambda of: F.array_except(F.split(of, _APART), dropped)
    compounds = F.regexp_extract_all(lower, F.lit(_COMPOUND), F.lit(0))
    hyphenated = F.flatten(F.transform(compounds, lambda c: F.concat(F.array(c), _longer(F.split(c, "-")))))
    camels = F.regexp_extract_all(text, F.lit(_CAMEL), F.lit(0))
    mixed = F.flatten(F.transform(camels, lambda c: _longer(F.concat(F.array(F.lower(c)), F.transform(F.split(c, "(?=[A-Z])"), F.lower)))))
    every = F.array_distinct(F.concat(hyphenated, mixed, words(F.regexp_replace(lower, _COMPOUND, " "))))
    return F.when(text.rlike("[A-Za-z0-9]-[A-Za-z0-9]|[a-z0-9][A-Z]"), every).otherwise(words(lower))


def split_identifier(name: Column) -> Column:
    """Words of an identifier: camel case, acronyms, digits, underscores and hyphens."""
    clean = F.regexp_replace(F.regexp_replace(name, r"^[_$]+", ""), r"[_$]+$", "")
    marked = clean
    for pattern in (r"([a-z])([A-Z])", r"([A-Z]+)([A-Z][a-z])", r"([a-zA-Z])(\d)", r"(\d)([a-zA-Z])"):
        marked = F.regexp_replace(marked, pattern, "$1-$2")
    words = F.filter(F.split(marked, "[_-]+"), lambda w: w != "")
    return F.when(F.size(words) > 0, words).otherwise(F.array(name))


def phrase(words: Column) -> Column:
    """Words as a phrase; short acronyms keep their case."""
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike("^[A-Z]{1,4}$"), w).otherwise(F.lower(w))), " ")


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))


def pluralize(word: Column) -> Column:
    return F.when(word.endswith("y"), F.concat(word.substr(F.lit(1), F.length(word) - 1), F.lit("ies"))).when(word.endswith("s"), F.concat(word, F.lit("es"))).otherwise(F.concat(word, F.lit("s")))


def normalise_type(name: Column) -> Column:
    """A type name without const, spaces around * and &, and qualifiers."""
    name = F.trim(F.regexp_replace(F.regexp_replace(name, r"\bconst\b\s*", ""), r"\s*([*&])\s*", "$1"))
    name = F.element_at(F.split(name, "::"), -1)
    return F.element_at(F.split(name, r"\."), -1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """The folder of a path; empty at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot, empty if there is none; Dockerfiles have one of their own."""
    name = basename(path)
    found = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return F.when(F.lower(name) == "dockerfile", F.lit(".dockerfile")).otherwise(F.lower(found))


def resolve_relative(base: Column, path: Column) -> Column:
    """A relative path from a folder, with . and .. folded."""
    parts = F.filter(F.concat(F.split(base, "/"), F.split(path, "/")), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    folded = F.aggregate(parts, empty, lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(folded, "/")


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in fixed.LANGUAGES.items() for x in pair])
    return F.try_element_at(table, extension(path))


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression over whole paths: ** crosses folders, * and ? do not."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if not c.isalnum() and c not in "/_" else c), i + 1
    return f"^{out}$" if "/" in glob else f"(?:^|/){out}$"


def parse_node_id(node_id: Column) -> Column:
    """struct(repo, path, symbol) of repo/path::symbol; the repo is the first segment."""
    file = F.substring_index(node_id, "::", 1)
    at = F.instr(file, "/")
    symbol = F.when(F.instr(node_id, "::") > 0, node_id.substr(F.instr(node_id, "::") + 2, F.length(node_id)))
    repo = F.when(at > 0, file.substr(F.lit(1), at - 1)).otherwise(file)
    path = F.when(at > 0, file.substr(at + 1, F.length(file)))
    return F.struct(repo.alias("repo"), path.alias("path"), symbol.alias("symbol"))


def normalise_url(url: Column) -> Column:
    """A repository address as https, without .git and a slash at the end."""
    trimmed = F.trim(url)
    https = F.regexp_replace(trimmed, r"^(?:ssh://)?git@([^:/]+)[:/](.+)$", "https://$1/$2")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(https, r"^http://", "https://"), r"/+$", ""), r"\.git$", "")


def truncate_patch(patch: Column, limit: int = 5000) -> Column:
    return F.when(F.length(patch) > limit, F.concat(F.substring(patch, 1, limit), F.lit("\n... (truncated)"))).otherwise(patch)


#: A word edge between ASCII word characters, as \\b is elsewhere; Java's own takes letters of all scripts.
_EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def any_of(patterns: list[str]) -> str:
    """One pattern for several, each with flags of its own."""
    return "|".join(f"(?:{p})" for p in patterns)


def _literals(pattern: str) -> list[str]:
    """Texts that all matches of a pattern of this file's kind hold: what is left of it without edges, spaces and gaps."""
    plain = re.sub(r"\\b|\\s\*|\.\*", " ", pattern.removeprefix("(?i)"))
    return re.sub(r"\\(.)", r"\1", re.sub(r"\\[A-Za-z].*|(?<!\\)[*+?|\[\](){}^$.].*", "", plain)).split()


def domain_tags(source: Column, most: int = 4) -> Column:
    """The first domains, in order, that a source has patterns of. Whole words, whatever their
    case, are looked up in the source's words, which are split once and met with all domains' words once; other
    patterns are matched in sources that hold their literal parts."""
    whole = {name: [(p, re.fullmatch(r"\(\?i\)\\b(\w+)\\b", p)) for p in patterns] for name, patterns in fixed.DOMAINS.items()}
    looked = {name: [m[1].lower() for _, m in patterns if m] for name, patterns in whole.items()}
    every = F.array(*[F.lit(w) for w in sorted({w for ws in looked.values() for w in ws})])

    def hit(x: Column, name: str) -> Column:
        found = F.arrays_overlap(x["words"], F.array(*[F.lit(w) for w in looked[name]]))
        for p in [p for p, m in whole[name] if not m]:
            held = [x["lower" if p.startswith("(?i)") else "text"].contains(part.lower() if p.startswith("(?i)") else part) for part in _literals(p)]
            found = found | reduce(Column.__and__, [*held, x["text"].rlike(p.replace(r"\b", _EDGE))])
        return found

    lower = F.lower(source)
    once = F.array(F.struct(source.alias("text"), lower.alias("lower"), F.array_intersect(F.split(lower, _APART), every).alias("words")))
    tags = lambda x: F.array_compact(F.array(*[F.when(hit(x, name), F.lit(name)) for name in fixed.DOMAINS]))
    return F.slice(F.transform(once, tags)[0], 1, most)


def sub_type(kind: Column, name: Column, properties: Column) -> Column:
    """The facet below a node's type: extension, language, registry or kind."""
    prop = lambda key: F.nullif(F.get_json_object(properties, f"$.{key}"), F.lit(""))
    return (
        F.when(kind == "File", F.nullif(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1), F.lit("")))
        .when(kind.isin("Function", "Class"), prop("language"))
        .when(kind == "Dependency", prop("registry"))
        .otherwise(prop("kind"))
    )


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix. Of many strings it is that of the smallest and the largest."""
    n = F.least(F.length(a), F.length(b))
    matched = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (i <= n) & (a.substr(i, F.lit(1)) == b.substr(i, F.lit(1))), i).otherwise(acc))
    return a.substr(F.lit(1), matched)


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def _tags(source: Column) -> Column:
    found = domain_tags(F.coalesce(source, F.lit("")))
    return F.when(F.size(found) > 0, F.concat(F.lit(" ["), F.array_join(found, ", "), F.lit("]"))).otherwise(F.lit(""))


def summarise_function(name: Column, receiver: Column, source: Column) -> Column:
    """A phrase for a function from its name."""
    words = split_identifier(name)
    rest = F.slice(words, F.lit(2), F.size(words))
    verb = _lookup(fixed.VERBS, F.lower(words[0]))
    thing = F.when(F.size(rest) > 0, F.concat(F.lit(" "), phrase(rest))).otherwise(F.lit(""))
    tested = F.when((F.lower(words[0]) == "test") & (F.size(words) > 1), phrase(rest)).when(F.lower(words[0]) == "test", name).otherwise(phrase(words))
    vague = F.length(name) <= 2
    said = (
        F.when(verb.isNotNull() & receiver.isNotNull(), F.concat(receiver, F.lit(" method that "), F.lower(verb), thing))
        .when(verb.isNotNull(), F.concat(verb, thing))
        .when(receiver.isNotNull(), F.concat(receiver, F.lit(" method for "), phrase(words)))
        .otherwise(capitalised(phrase(words)))
    )
    return (
        F.when(name.isin("__init__", "constructor", "init", "new"), F.concat(F.lit("Initializes "), F.coalesce(receiver, F.lit("instance"))))
        .when(F.lower(name).startswith("test"), F.concat(F.lit("Tests "), tested))
        .when(vague, F.concat(F.lit("Function "), name))
        .otherwise(F.concat(said, _tags(source)))
    )


def _listing(names: Column, most: int) -> Column:
    more = F.when(F.size(names) > most, F.concat(F.lit(" and "), (F.size(names) - most).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return F.concat(F.array_join(F.slice(names, 1, most), ", "), more)


def summarise_class(name: Column, children: Column, source: Column) -> Column:
    firsts = F.transform(children, lambda c: F.lower(split_identifier(c)[0]))
    crud = F.size(F.filter(firsts, lambda c: c.isin("create", "read", "get", "find", "update", "delete", "remove", "save", "list"))) >= 3
    methods = F.when(F.size(children) > 0, F.concat(F.lit(" with methods: "), _listing(children, 5))).otherwise(F.lit(""))
    return F.concat(capitalised(phrase(split_identifier(name))), F.when(crud, F.lit(" for CRUD operations")).otherwise(F.lit("")), methods, _tags(source))


def summarise_file(name: Column, symbols: Column, language: Column) -> Column:
    stem = reduce(lambda c, p: F.regexp_replace(c, p, ""), (r"_test\.\w+$", r"\.test\.\w+$", r"\.spec\.\w+$", r"^test_", r"\.\w+$"), name)
    known = F.coalesce(*[F.when(F.lower(name).rlike(p), F.lit(said)) for p, said in fixed.FILES])
    defines = F.concat(F.lit("Defines"), F.coalesce(F.concat(F.lit(" "), language), F.lit("")), F.lit(" "), _listing(symbols, 3))
    return (
        F.when(known.endswith("for"), F.concat(known, F.lit(" "), phrase(split_identifier(stem))))
        .when(known.isNotNull(), known)
        .when(F.size(symbols) > 0, defines)
        .otherwise(F.concat(F.lit("Source file "), name))
    )


def summarise_folder(name: Column, children: Column) -> Column:
    known = _lookup(fixed.FOLDERS, F.lower(name))
    return F.when((F.size(children) > 0), F.concat(F.coalesce(known, F.lit("Directory")), F.lit(" containing "), _listing(children, 5))).otherwise(F.coalesce(known, F.concat(F.lit("Directory "), name)))


def first_sentence(docs: Column) -> Column:
    """The author's own first sentence, without its stop; null if there is none."""
    first = F.trim(F.split(docs, r"\.\s|\n", 2)[0])
    return F.nullif(F.regexp_replace(first, r"\.$", ""), F.lit(""))
