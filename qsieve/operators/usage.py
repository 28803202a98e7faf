"""Code-usage extraction for JavaScript/TypeScript files.

Spark selects the files by language.  A small tokeniser is the only Python: it
leaves out files without any known name (Arrow's linear search) and turns a
content into arrays with one entry per token, in one linear pass.  All that is found in them is
found by column expressions over these arrays, in the row, without a shuffle:

* U1, W3 — comments, strings, templates and regex literals are tokens; code
  inside a template's `${…}` is code.  Each token knows its partner bracket
  (`mate`), the bracket around it (`up`) and where the member chain that ends
  with it begins (`head`).
* U2–U6 — an import's source, a call's first argument, an option object's
  pairs are read by index over any number of lines and any nesting: arguments
  and pairs are the tokens whose `up` is the call's or the object's bracket.
  A site stands at the start of its statement or of its whole call chain.
* J2–J4 — sites join the fixed pattern dimensions with broadcast equi-joins
  (package root; method; object+method); the first pattern in list order is
  picked inside the row from the ordered candidate array.  J5 — the rule
  attributes come from the rule dimension (inner join: unknown rule → none).

Null contents give no site; unclosed brackets and strings end with the file
or line.  A `/` divides after an operand, `++` and `--`, and after `)` unless
an `if`, `while`, `for` or `with` opened it.  Known limit: text between JSX
tags is read as code.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate, chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import catalog as C
from ..sources.rules import rule_rows
from .lines import FINDING_COLS, JS_TRIM, snippet

USAGE_LANGUAGES = ["javascript", "typescript"]

CALL_METHODS = sorted({m for m, *_ in C.CALL_PATTERNS})
OPTION_CALLS = sorted({(o, m) for o, m, *_ in C.OPTION_PATTERNS})
# Test (RE2, ASCII boundaries) for files that can hold a site at all.
HEAD_ANY = r"\b(?:import|require|" + "|".join(CALL_METHODS + sorted({o for o, _ in OPTION_CALLS})) + r")\b"

NAMES = sorted(set(CALL_METHODS) | {m for _, m in OPTION_CALLS} | {"require"})
# an import's clause has at most eight elements: type, name, comma, *, as, name or {…}, from, source
CLAUSE = 12
# Of a stretch of plain words the tokens kept at its beginning and the words
# kept at its end: no site rule looks over as many (an import's clause looks
# CLAUSE elements ahead, a call three tokens back).  Before a file's first mark
# or name nothing looks ahead, so one token is kept there.
KEPT_FIRST, KEPT_TOKENS, KEPT_WORDS = 1, 16, 4

TOKEN_SCHEMA = ("repo string, path string, known array<int>, tok array<string>, lit array<string>, quoted array<boolean>, noted array<boolean>, mate array<int>, up array<int>, "
                "head array<int>, called array<boolean>, line array<int>, col array<int>, lines array<string>")


# --------------------------------------------------------------- tokeniser

def _tokens():
    """A `mapInArrow` function: (repo, path, content) → TOKEN_SCHEMA rows of the
    files that hold a known name.  All it needs is nested here, so executors need
    not import this package.

    known: the numbers of the tokens that are known names; tok: a mark's or word's text, else empty; lit: what a closed string or
    template holds; quoted: the token is a string; noted: a comment stands just
    before; mate, up, head: token numbers or -1; called: the chain holds a call;
    line, col: from 1, col in UTF-16 units; lines: trimmed for the snippet, empty
    where no site can begin.

    In a long stretch without brackets, quotes, slashes and known names, the
    tokens between its beginning and its end are left out: no site stands
    there, none reaches over it, and its elements and pairs hold no string.  It
    is cut after a word or number, and goes on with a word after a blank and no dot,
    so no member chain crosses."""
    names, kept_first, kept_tokens, kept_words = frozenset(NAMES), KEPT_FIRST, KEPT_TOKENS, KEPT_WORDS
    n_snippet, trim, most, head_any = C.SNIPPET_CHARS, JS_TRIM, 100_000, HEAD_ANY
    known_names = names | {"import"}
    plain = re.compile(r"[^\"'`/()\[\]{}]*+")
    gap = re.compile(r"[^\s.]\s++(?=[A-Za-z_$\u0080-\U0010ffff])")
    lexeme = re.compile(
        r"\s*+(?:(?P<comment>//[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/)?)"
        r'|(?P<string>"(?:[^"\\\n]|\\[\s\S])*+"?|\'(?:[^\'\\\n]|\\[\s\S])*+\'?)'
        r"|(?P<word>[A-Za-z_$\u0080-\U0010ffff][\w$]*+)"
        r"|(?P<number>\d[\w.]*+)"
        r"|(?P<mark>\?\.(?!\d)|=>|\+\+|--|\S))")
    regex = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[A-Za-z]*+")
    chunk = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+")
    type_args = re.compile(r"\s*<[\w$\s,.\[\]|&<>{}:?\"']*>(?=\s*\()")
    # after these words an expression starts, so a `/` opens a regex literal
    starters = frozenset("return typeof case in of do else void delete throw new instanceof yield await default extends".split())
    opener, dots = {")": "(", "]": "[", "}": "{"}, (".", "?.")
    chained = frozenset([")", "]", "}", "!", *dots])

    def places(src):
        """Where known names stand, in a longer word too."""
        for name in known_names:
            at = src.find(name)
            while at >= 0:
                yield at
                at = src.find(name, at + 1)

    def read(src):
        """Kind, text and beginning of each token; the partners of brackets, what
        strings hold, the tokens after a comment, known names and templates' ends."""
        kind, tok, start, mate, lit, noted, known, ends = [], [], [], {}, {}, [], [], []
        stack, depth, pos, n = [], {"(": 0, "[": 0, "{": 0}, 0, len(src)
        # where a plain stretch ends at the latest; the tokens before the present stretch and how many of it stay; how far it was looked at
        stops, before, kept, looked = sorted([n, *places(src)], reverse=True), 0, kept_first, 0
        add_kind, add_tok, add_start, read_one = kind.append, tok.append, start.append, lexeme.match

        def operand(i):
            """Whether an expression can end with token i."""
            return i >= 0 and (kind[i] in "snrt" or tok[i] in (")", "]", "++", "--") or kind[i] == "w" and tok[i] not in starters)

        def divides(i):
            """Whether a `/` after token i is a division."""
            if i >= 0 and tok[i] == ")" and (o := mate.get(i, -1)) > 0 and tok[o - 1] in ("if", "while", "for", "with"):
                return o > 1 and tok[o - 2] in (".", "?.")
            return operand(i)

        def close_last():
            o, c = stack.pop(), len(kind) - 1
            mate[o], mate[c] = c, o
            if tok[o] == "`":
                lit[o] = src[start[o] + 1:start[c]]

        k = ""
        while pos < n:
            if stack and tok[stack[-1]] == "`":
                pos = chunk.match(src, pos).end()
                if src.startswith("`", pos):
                    ends.append(len(kind))
                    add_kind("t"), add_tok(""), add_start(pos)
                    close_last()
                    pos += 1
                elif src.startswith("${", pos):
                    stack.append(len(kind))
                    add_kind("m"), add_tok("${"), add_start(pos)
                    depth["{"] += 1
                    pos += 2
                else:  # the file ends here
                    break
                k = ""
                continue
            if (k == "w" or k == "n") and pos >= looked and len(kind) - before >= kept:
                while stops[-1] < pos:
                    stops.pop()
                looked = min(plain.match(src, pos).end(), stops[-1])
                words = [w.end() for w in gap.finditer(src, max(pos, looked - 40 * kept_words), looked)]
                if len(words) > kept_words:
                    pos = words[-kept_words]
            m = read_one(src, pos)
            if m is None:  # blanks at the end
                break
            group = m.lastindex
            at, pos = m.span(group)
            if group == 3:  # word
                k, word = "w", src[at:pos]
                if word in known_names:
                    known.append(len(kind))
                    add_kind(k), add_tok(word), add_start(at)
                    before, kept = len(kind), kept_tokens
                    if word != "import" and (t := type_args.match(src, pos)):
                        pos = t.end()
                    continue
                add_kind(k), add_tok(word), add_start(at)
                continue
            if group == 1:  # comment
                before, kept, k = len(kind), kept_tokens, ""
                noted.append(len(kind))
                continue
            if group != 5:  # string or number
                if group == 2:
                    k = "s"
                    if pos - at > 1 and src[pos - 1] == src[at]:
                        lit[len(kind)] = src[at + 1:pos - 1]
                    add_kind(k), add_tok(""), add_start(at)
                    before, kept = len(kind), kept_tokens
                else:
                    k = "n"
                    add_kind(k), add_tok(""), add_start(at)
                continue
            k, c = "m", src[at]
            r = regex.match(src, at) if c == "/" and not divides(len(kind) - 1) else None
            if r:
                k, pos = "r", r.end()
                add_kind(k), add_tok(""), add_start(at)
            else:
                add_kind(k), add_tok(src[at:pos]), add_start(at)
            if c in "()[]{}`/":
                before, kept = len(kind), kept_tokens
                if k == "m" and c in "([{`":
                    stack.append(len(kind) - 1)
                    if c != "`":
                        depth[c] += 1
                elif c in opener and depth[opener[c]]:
                    while stack:
                        t = tok[stack[-1]][-1]
                        if t != "`":
                            depth[t] -= 1
                        if t == opener[c]:
                            close_last()
                            break
                        stack.pop()
        if noted and noted[-1] == len(kind):  # a comment that ends the file
            noted = [i for i in noted if i < len(kind)]
        return kind, tok, start, mate, lit, noted, known, ends, operand

    def chains(kind, tok, mate, ends, operand):
        """For each token, where the member chain that ends there begins, and
        the tokens whose chain holds a call."""
        head, called, n = list(range(len(tok))), set(), len(tok)
        asked = {i + (t in dots) for i, t in enumerate(tok) if t in chained}
        for e in sorted(asked.union(ends, [i + 1 for i in asked if i < n and tok[i] in dots])):
            if e == n:
                break
            i, last = e, tok[e - 1] if e else ""
            if kind[e] != "w":
                while i > 0 and tok[i] == "!":
                    i -= 1
                if (tok[i] in (")", "]", "}") or kind[i] == "t") and i in mate:
                    i, closing = mate[i], tok[i]
                    before = i - 1 - (i > 0 and tok[i - 1] == "?.")
                    if closing != "}" and (operand(before) and tok[before] not in ("++", "--") and kind[before] not in "nr"):
                        head[e] = head[before]
                        if before in called or closing == ")":
                            called.add(e)
                        continue
                last = tok[i - 1] if i else ""
            if i > 1 and last in dots:
                head[e] = head[i - 2]
                if i - 2 in called:
                    called.add(e)
            else:
                head[e] = i
        return head, called

    def row(src):
        """What is known of a file; nothing, if it holds no known name."""
        kind, tok, start, mate, lit, noted, known, ends, operand = read(src)
        if not known:
            return None
        head, called = chains(kind, tok, mate, ends, operand)
        up, held, top, done = [], [], -1, 0
        for i in sorted(mate):
            up.extend([top] * (i - done))
            if held and mate[top] == i:
                held.pop()
                top = held[-1] if held else -1
            up.append(top)
            if mate[i] > i:
                held.append(i)
                top = i
            done = i + 1
        up.extend([top] * (len(tok) - done))
        breaks = [-1, *(m.start() for m in re.finditer("\n", src)), len(src)]
        astral = [] if src.isascii() else [m.start() for m in re.finditer("[\U00010000-\U0010ffff]", src)]
        begins = {bisect_left(breaks, start[j], 1) for i in known for j in ((i, head[i - 2], max(head[i - 2] - 1, 0)) if i > 1 else (i,))}
        lines = [""] * max(begins)
        for no in begins:
            lines[no - 1] = src[breaks[no - 1] + 1:breaks[no]].strip(trim)[:n_snippet]
        return known, tok, lines, up, head, "".join(kind), lit, mate, noted, called, start, breaks, astral

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        columns = ["repo", "path", "known", "tok", "lit", "quoted", "noted", "mate", "up", "head", "called", "line", "col", "lines"]

        def packed(files):
            repo, path, known, tok, lines, up, head, kind, lit, mate, noted, called, start, breaks, astral = zip(*files)
            flat = chain.from_iterable
            offsets = lambda lists: np.array([0, *accumulate(map(len, lists))], np.int32)
            at, n = offsets(tok), sum(map(len, tok))
            listed = lambda values, of=None: pa.ListArray.from_arrays(pa.array(at if of is None else offsets(of)), values)
            placed = lambda sets: [a + x for a, s in zip(at.tolist(), sets) for x in s]
            lits, mates, marks = [None] * n, np.full(n, -1, np.int32), np.zeros((2, n), bool)
            for a, s in zip(at.tolist(), lit):
                for i, x in s.items():
                    lits[a + i] = x
            mates[placed(mate)] = list(flat(m.values() for m in mate))
            marks[0, placed(noted)] = marks[1, placed(called)] = True
            # all files' places on one axis: a token's line is that of the next break
            base = np.array([0, *accumulate(b[-1] + 2 for b in breaks)], np.int64)
            ends, begin = np.fromiter(flat(breaks), np.int64), np.fromiter(flat(start), np.int64, n)
            first = offsets(breaks)
            ends += np.repeat(base[:-1], np.diff(first))
            begin += np.repeat(base[:-1], np.diff(at))
            line = np.searchsorted(ends, begin)
            col = begin - ends[line - 1]
            line -= np.repeat(first[:-1], np.diff(at))
            for a, b, begins, wide in zip(at, at[1:], start, astral):
                if wide:
                    col[a:b] += [bisect_left(wide, x) - bisect_left(wide, x - c + 1) for x, c in zip(begins, col[a:b].tolist())]
            numbers = lambda x: pa.array(np.fromiter(flat(x), np.int32))
            arrays = [listed(numbers(known), known), listed(pa.array(list(flat(tok)), pa.string())), listed(pa.array(lits, pa.string())),
                      listed(pa.array(np.frombuffer("".join(kind).encode(), np.uint8) == ord("s"))), listed(pa.array(marks[0])), listed(pa.array(mates)),
                      listed(numbers(up)), listed(numbers(head)), listed(pa.array(marks[1])), listed(pa.array(line.astype(np.int32))),
                      listed(pa.array(col.astype(np.int32))), listed(pa.array(list(flat(lines)), pa.string()), lines)]
            return pa.RecordBatch.from_arrays([pa.array(repo, pa.string()), pa.array(path, pa.string()), *arrays], columns)

        for batch in batches:
            batch = batch.filter(pc.match_substring_regex(batch["content"], head_any))
            held, n = [], 0
            for repo, path, content in zip(*(c.to_pylist() for c in batch.columns)):
                if made := row(content):
                    held.append((repo, path, *made))
                    n += len(made[1])
                if n >= most:  # tokens
                    yield packed(held)
                    held, n = [], 0
            if held:
                yield packed(held)

    return run


# ----------------------------------------------- sites, by column expressions

def _at(array: str, i: Column | int) -> Column:
    return F.get(F.col(array), F.lit(i) if isinstance(i, int) else i)


def _is(i: Column, *texts: str) -> Column:
    """Whether token i is one of these marks or words."""
    return F.coalesce(_at("tok", i).isin(*texts), F.lit(False))


def _string(i: Column, stops: tuple[str, ...], template: bool = True) -> Column:
    """What a string holds that is a whole element, else null."""
    last = F.when(_at("quoted", i), i).otherwise(_at("mate", i))
    whole = (~_at("noted", i)) & _is(last + 1, *stops)
    return F.when(whole if template else whole & _at("quoted", i), _at("lit", i))


def _import_source(i: Column) -> Column:
    """The token of the source of the import statement at token i, or -1."""
    def step(s: Column, _: Column) -> Column:
        j = s["j"]
        found = _is(j, "from") & F.coalesce(_at("quoted", j + 1), F.lit(False))
        word = F.coalesce(_at("tok", j).rlike(r"^[A-Za-z_$\x80-\x{10ffff}]"), F.lit(False)) & ~_is(j, "import")
        after = F.when(_at("mate", j) > j, _at("mate", j) + 1).otherwise(j + 1)
        return (F.when(s["done"], s)
                .when(found, F.struct((j + 1).alias("j"), F.lit(True).alias("done")))
                .when(word | _is(j, "{", "*", ","), F.struct(after.alias("j"), F.lit(False).alias("done")))
                .otherwise(F.struct(F.lit(-1).alias("j"), F.lit(True).alias("done"))))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(CLAUSE)), F.struct((i + 1).alias("j"), F.lit(False).alias("done")), step,
                         lambda s: F.when(s["done"], s["j"]).otherwise(-1))
    return F.when(F.coalesce(_at("quoted", i + 1), F.lit(False)), i + 1).otherwise(walked)


def _parts(open_: Column) -> Column:
    """The first tokens of a bracket's elements."""
    return F.filter(F.sequence(open_ + 1, _at("mate", open_)), lambda k: (k < _at("mate", open_)) & ((k == open_ + 1) | (_is(k - 1, ",") & (_at("up", k - 1) == open_))))


def _pairs(open_: Column) -> Column:
    """The pairs (key, string values) of the objects among a call's arguments."""
    objects = F.filter(_parts(open_), lambda a: _is(a, "{") & (_at("mate", a) > a) & _is(_at("mate", a) + 1, ",", ")"))
    keys = F.filter(F.flatten(F.transform(objects, _parts)), lambda p: _is(p + 1, ":"))

    def values(p: Column) -> Column:
        one = _string(p + 2, (",", "}"), template=False)
        is_list = _is(p + 2, "[") & (_at("mate", p + 2) > 0) & _is(_at("mate", p + 2) + 1, ",", "}")
        many = F.filter(F.transform(_parts(p + 2), lambda e: _string(e, (",", "]"))), lambda v: v != "")
        return F.when(one != "", F.array(one)).when(is_list, many)

    return F.filter(F.transform(keys, lambda p: F.struct(_at("tok", p).alias("k"), values(p).alias("vs"))), lambda kv: kv["vs"].isNotNull())


_NO_PAIRS = "array<struct<k: string, vs: array<string>>>"


def _site(at: Column, kind: str, name: Column, argv: Column | None = None, pairs: Column | None = None) -> Column:
    return F.struct(at.alias("at"), F.lit(kind).alias("kind"), name.alias("name"), (F.lit(None).cast("string") if argv is None else argv).alias("argv"),
                    (F.lit(None).cast(_NO_PAIRS) if pairs is None else pairs).alias("pairs"))


def _around(i: Column) -> Column:
    """What the site rules ask about the known word at token i: whether it is a
    member, where its argument list would open (j), where its chain begins."""
    member = _is(i - 1, ".", "?.")
    return F.struct(i.alias("i"), _at("tok", i).alias("tok"), member.alias("member"), F.when(member & (i > 1), _at("head", i - 2)).otherwise(i).alias("start"),
                    F.when(_is(i + 1, "?.") & _is(i + 2, "("), i + 2).otherwise(i + 1).alias("j"),
                    F.when(_is(i, "import"), _import_source(i)).otherwise(-1).alias("source"))


def _judged(w: Column) -> Column:
    """Whether it is an import statement or a call, where the site begins, and
    the first argument where that is a string."""
    i, j, start, source, member = w["i"], w["j"], w["start"], w["source"], w["member"]
    new = member & (i > 1) & _is(start - 1, "new")
    declared = ~member & (_is(i - 1, "function", "new") | ((_at("mate", j) > 0) & _is(_at("mate", j) + 1, "{")))
    called = (w["tok"] != "import") & _is(j, "(") & ~declared & ~(new & ~_at("called", i - 2))
    imported = (~(member & (_at("line", i - 1) == _at("line", i))) & F.coalesce(_at("quoted", source), F.lit(False))
                & ((source == i + 1) | _is(source - 1, "from")) & (_at("lit", source) != ""))
    return F.struct(i.alias("i"), w["tok"].alias("tok"), member.alias("member"), j.alias("j"), F.when(new, start - 1).otherwise(start).alias("first"),
                    F.when((w["tok"] == "import") & imported, _at("lit", source)).alias("source"), called.alias("called"), _string(j + 1, (",", ")")).alias("argv"))


def _sites_of(w: Column) -> Column:
    """The sites (0 to 2) of a known word."""
    i, j, first, argv, call = w["i"], w["j"], w["first"], w["argv"], w["called"]
    required = call & (w["tok"] == "require") & ~w["member"] & (argv != "") & ~(_is(i - 1, "=") & _is(i - 3, "import"))
    target = F.concat(_at("tok", first), F.lit("."), w["tok"])
    option = call & w["member"] & (first == i - 2) & target.isin([f"{o}.{m}" for o, m in OPTION_CALLS]) & (_at("mate", j) > j)
    return F.array(
        F.when(w["source"].isNotNull(), _site(i, "import", w["source"])).when(required, _site(i, "import", argv)),
        F.when(call & w["tok"].isin(CALL_METHODS), _site(first, "call", w["tok"], F.when(argv != "", F.lower(argv)))),
        F.when(option, _site(first, "option", target, pairs=_pairs(j))))


def sites(files: DataFrame) -> DataFrame:
    """The sites of the JavaScript/TypeScript files, with the pattern
    dimension's key.  Narrow: no shuffle.  A table of `write_files_table` is
    filtered on its partition column, so only JS/TS partitions are read."""
    if "lang_part" in files.columns:
        files = files.where(F.col("lang_part").isin(USAGE_LANGUAGES))
    tokens = (files.where(F.col("language").isin(USAGE_LANGUAGES) & F.col("content").isNotNull())
              .select("repo", "path", "content").mapInArrow(_tokens(), TOKEN_SCHEMA))
    found = F.flatten(F.transform(F.transform(F.transform("known", _around), _judged), _sites_of))
    placed = F.transform(F.filter(found, lambda s: s.isNotNull()), lambda s: F.struct(
        _at("line", s["at"]).alias("line_no"), _at("col", s["at"]).alias("column"), F.get("lines", _at("line", s["at"]) - 1).alias("line"),
        s["kind"].alias("kind"), s["name"].alias("name"), s["argv"].alias("argv"), s["pairs"].alias("pairs")))
    read = tokens.select("repo", "path", F.explode(placed).alias("s")).select("repo", "path", "s.*")
    name = F.when(F.col("kind") == "import", package_root(F.col("name"))).otherwise(F.col("name"))
    return read.select("repo", "path", "line_no", "column", "line", "kind",
                       F.concat("kind", F.lit(":"), name).alias("site_key"), "argv", "pairs")


# ------------------------------------------------------- pattern dimensions

_CAND = T.StructType([
    T.StructField("pattern_ord", T.IntegerType()),
    T.StructField("args", T.ArrayType(T.StringType())),
    T.StructField("prop", T.StringType()),
    T.StructField("values", T.ArrayType(T.StringType())),
    T.StructField("rule_id", T.StringType()),
    T.StructField("confidence", T.DoubleType())])
PATTERN_DIM_SCHEMA = T.StructType([T.StructField("site_key", T.StringType()),
                                   T.StructField("candidates", T.ArrayType(_CAND))])


def pattern_dimension(spark) -> DataFrame:
    """The three usage-pattern tables as one dimension keyed by site key:
    `import:<package>` (J2), `call:<method>` (J3), `option:<obj>.<method>`
    (J4); each key holds its candidate patterns in list order.  Size is that
    of the catalogue (33 patterns), independent of the data."""
    by_key: dict[str, list] = {}
    for i, (pkgs, rid, conf) in enumerate(C.IMPORT_PATTERNS):
        for p in pkgs:
            by_key.setdefault("import:" + p, []).append((i, [], None, [], rid, float(conf)))
    for i, (m, args, rid, conf) in enumerate(C.CALL_PATTERNS):
        by_key.setdefault("call:" + m, []).append(
            (i, [a.lower() for a in args], None, [], rid, float(conf)))
    for i, (o, m, prop, vals, rid, conf) in enumerate(C.OPTION_PATTERNS):
        by_key.setdefault(f"option:{o}.{m}", []).append((i, [], prop, list(vals), rid, float(conf)))
    from ..session import dimension
    return dimension(spark, "usage_patterns",
                     lambda: spark.createDataFrame(list(by_key.items()), PATTERN_DIM_SCHEMA))


def package_root(pkg: Column) -> Column:
    """`@scope/name/...` → `@scope/name`; `name/...` → `name`.  Every import
    pattern is a root, so `pkg == p or pkg startswith p + '/'` is equality of
    roots (an equi-join)."""
    return F.when(pkg.startswith("@"), F.regexp_extract(pkg, r"^(@[^/]*/[^/]*|@[^/]*)", 1)) \
        .otherwise(F.regexp_extract(pkg, r"^([^/]*)", 1))


def first_candidate() -> Column:
    """First pattern (list order) of the joined key that accepts the site:
    imports always; calls when the pattern has no argument list or the first
    string argument starts with one of its arguments; options when a pair
    with the pattern's key has a value among the pattern's values."""
    def ok(c):
        call_ok = (F.size(c["args"]) == 0) | (F.col("argv").isNotNull() & F.exists(
            c["args"], lambda a: F.col("argv").startswith(a)))
        opt_ok = F.coalesce(F.exists(F.col("pairs"), lambda kv: (kv["k"] == c["prop"])
                                     & F.arrays_overlap(kv["vs"], c["values"])), F.lit(False))
        return (F.when(F.col("kind") == "import", F.lit(True))
                .when(F.col("kind") == "call", call_ok).otherwise(opt_ok))
    return F.try_element_at(F.filter("candidates", ok), F.lit(1))


def usage_findings(files: DataFrame, rules=None) -> DataFrame:
    """Usage-branch findings (phase 1, method 'ast') for readable files."""
    spark = files.sparkSession
    st = sites(files)
    # the first candidate is produced by a (0/1-row) generator, so later
    # filters on it are not inlined into several copies of the expression
    first = F.filter(F.array(first_candidate()), lambda x: x.isNotNull())
    hits = (st.join(F.broadcast(pattern_dimension(spark)), "site_key")
            .select("repo", "path", "line_no", "line", "column", F.explode(first).alias("p"))
            .select("repo", "path", "line_no", "line", "column", "p.rule_id", "p.confidence"))
    rdim = F.broadcast(_rule_attrs(spark, rules))
    out = hits.join(rdim, "rule_id").select(
        "repo", "rule_id", "description", "severity", "category", "algorithm", "replacement",
        "effort", F.col("path").alias("file"), F.col("line_no").alias("line"),
        "column", snippet(F.col("line")).alias("snippet"),
        F.lit("ast").alias("detection_method"), F.col("confidence"),
        F.lit(C.PHASE_USAGE).alias("phase"), F.lit(0).alias("rule_ord"))
    return out.select(*FINDING_COLS)


def _rule_attrs(spark, rules) -> DataFrame:
    """Rule attributes by id; a duplicated id resolves to its last rule
    (a map built in file order).  Catalogue and list rules are configuration:
    resolved once into a cached dimension; a user rule DataFrame is resolved
    with an aggregate."""
    if isinstance(rules, DataFrame):
        # only ids a usage pattern can emit: the broadcast side is bounded by
        # the pattern catalogue, whatever the size of the user table
        used = sorted({r for _, r, _ in C.IMPORT_PATTERNS} | {r for *_, r, _ in C.CALL_PATTERNS}
                      | {r for *_, r, _ in C.OPTION_PATTERNS})
        last = rules.where(F.col("rule_id").isin(used)).groupBy("rule_id").agg(F.max_by(F.struct(
            "description", "severity", "category", "algorithm", "replacement", "effort"),
            F.col("rule_ord")).alias("r"))
        return last.select("rule_id", "r.*")
    from ..session import dimension
    by_id = {r["rule_id"]: r for r in rule_rows(rules)}
    rows = [(k, r["description"], r["severity"], r["category"], r["algorithm"], r["replacement"],
             r["effort"]) for k, r in by_id.items()]
    return dimension(spark, "rule_attrs:" + repr(rows), lambda: spark.createDataFrame(
        rows, "rule_id string, description string, severity string, category string, "
              "algorithm string, replacement string, effort string"))
