"""Schema modules as rows: a tolerant parser for the statement language.

Files are read whole, one row each, and parsed on the executors in a single pass; what
joins files (groupings, submodules, augments) is done by joins on the rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import model
from tessera.functions.text import ancestors, strip_prefixes
from tessera.session import ship, stored

#: Space and notes, then a token: string, mark, plus between strings, word, any other character, or the end.
_TOKEN = re.compile(
    r"""(?:\s+|//[^\n]*|/\*.*?\*/)*+(?:("(?:\\.|[^"\\])*")|('[^']*')|([{};])|(\+(?=\s*["']))|((?:[^\s{};"'/]|/(?![/*]))+)|(.)|\Z)""",
    re.S,
)
_STRINGS, _MARK, _PLUS = (1, 2), 3, 4
#: Space and notes, then a whole statement up to its mark, a closing brace, the end, or the rest that is neither.
_QUOTED = r"""(?:"(?:\\.|[^"\\])*+"|'[^']*+')"""
_STRING = re.compile(_QUOTED, re.S)
_WORD = r"""(?:[^\s{};"'/]|/(?![/*]))++"""
_STATEMENT = re.compile(rf"""(\s*+(?:(?://[^\n]*+|/\*.*?\*/)\s*+)*+)(?:(?!\+\s*["'])({_WORD})(\s*+)(?:(?!\+\s*["'])({_WORD})|({_QUOTED})((?:\s*+\+\s*+{_QUOTED})*+))?(\s*+)([{{;])|(\}})|\Z|(.+))""", re.S)


@dataclass(slots=True)
class Statement:
    keyword: str
    arg: str | None
    line: int
    prefix: str | None = None
    children: list["Statement"] = field(default_factory=list)

    def first(self, keyword: str) -> str | None:
        for c in self.children:
            if c.keyword == keyword and not c.prefix:
                return c.arg
        return None

    def all(self, keyword: str) -> list["Statement"]:
        return [c for c in self.children if c.keyword == keyword and not c.prefix]


def _unquote(text: str) -> str:
    if text[0] == "'":
        return text[1:-1]
    if "\\" not in text and "\n" not in text:
        return text[1:-1]
    body = re.sub(r"\\([nt\"\\])", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])
    first, *rest = body.split("\n")
    return "\n".join([first.rstrip() if rest else first, *(x.strip() if i < len(rest) - 1 else x.lstrip() for i, x in enumerate(rest))])


def tokens(text: str) -> Iterator[tuple[str, str, int]]:
    """(kind, text, line): word, string or mark; strings joined by + are one."""
    line, seen, held = 1, 0, None
    plus = False
    for m in _TOKEN.finditer(text):
        kind = m.lastindex
        if kind is None:
            continue
        raw, begin = m[kind], m.start(kind)
        line += text.count("\n", seen, begin)
        seen = begin
        if kind == _PLUS:
            plus = True
            continue
        if kind in _STRINGS:
            if plus and held:
                held = ("string", held[1] + _unquote(raw), held[2])
            else:
                if held:
                    yield held
                held = ("string", _unquote(raw), line)
            plus = False
            continue
        plus = False
        if held:
            yield held
            held = None
        yield ("mark" if kind == _MARK else "word", raw, line)
    if held:
        yield held


#: Statements that stand in a module itself and nowhere deeper.
_TOP = ("namespace", "import", "include", "revision", "organization", "contact", "yang-version", "belongs-to", "feature", "identity", "extension", "rpc", "deviation")


def parse(text: str) -> list[Statement]:
    """Top statements of a text; any text gives a result, and a broken one its whole
    statements. What follows a closing brace too many stays in the module. Where blocks
    are left open, the layout closes them (a statement no deeper than an open one is not
    in it), if that accounts for every brace; else statements that can only stand in a
    module do. What then is open ends with the text."""
    events = _events(text)
    top, lacking, _ = _built(events, "", text)
    if not lacking:
        return top
    by_layout, still, closed = _built(events, "layout", text)
    return by_layout if closed == lacking and not still else _built(events, "top", text)[0]


def _events(text: str) -> list[tuple[str | None, str | None, int, str]]:
    """(keyword, argument, line, mark) of what each mark ends; the line is the keyword's, or
    the mark's where it ends nothing. The last may have no mark. A text that holds anything
    but whole statements is taken token by token."""
    out: list[tuple[str | None, str | None, int, str]] = []
    line = 1
    for lead, keyword, gap, word, string, more, tail, mark, close, odd in _STATEMENT.findall(text):
        if "\n" in lead:
            line += lead.count("\n")
        if keyword:
            if string:
                arg = _unquote(string)
                if more:
                    arg += "".join([_unquote(x) for x in _STRING.findall(more)])
                out.append((keyword, arg, line, mark))
                line += gap.count("\n") + string.count("\n") + more.count("\n") + tail.count("\n")
            else:
                out.append((keyword, word or None, line, mark))
                if "\n" in gap or "\n" in tail:
                    line += gap.count("\n") + tail.count("\n")
        elif close:
            out.append((None, None, line, close))
        elif odd:
            return _events_of_tokens(text)
    return out


def _events_of_tokens(text: str) -> list[tuple[str | None, str | None, int, str]]:
    out: list[tuple[str | None, str | None, int, str]] = []
    keyword, arg, at = None, None, 0
    for kind, raw, line in tokens(text):
        if kind == "mark":
            out.append((keyword, arg, line if keyword is None else at, raw))
            keyword = arg = None
        elif keyword is None:
            keyword, at = raw, line
        else:
            arg = raw if arg is None else f"{arg} {raw}"
    if keyword is not None:
        out.append((keyword, arg, at, ""))
    return out


def _built(events: list[tuple[str | None, str | None, int, str]], recovery: str, text: str) -> tuple[list[Statement], int, int]:
    """Top statements, the number of blocks left open, and of those that ``recovery`` closed."""
    root = Statement("", None, 0)
    stack, closed, top = [root], 0, root.children
    lines = text.split("\n") if recovery == "layout" else []
    columns: list[int | None] = [None]

    def column(word: str, line: int) -> int | None:
        """Where a line begins, if it does with this word."""
        whole = lines[line - 1]
        begin = len(whole) - len(whole.lstrip())
        return begin if whole.startswith(word, begin) else None

    def close(size: int) -> None:
        nonlocal closed
        closed += len(stack) - size
        del stack[size:], columns[size:]

    here: int | None = None
    for keyword, arg, line, mark in events:
        s = None
        if keyword is not None:
            if top and len(stack) == 1 and keyword not in ("module", "submodule") and top[-1].keyword in ("module", "submodule"):
                stack.append(top[-1])
                columns.append(None)
                closed -= 1
            if recovery == "layout":
                here = column(keyword, line)
                while here is not None and len(columns) > 1 and columns[-1] is not None and here <= columns[-1]:
                    close(len(stack) - 1)
            elif recovery == "top" and keyword in _TOP and len(stack) > 2:
                close(2)
            if ":" in keyword:
                prefix, _, name = keyword.rpartition(":")
                s = Statement(name, arg, line, prefix or None)
            else:
                s = Statement(keyword, arg, line)
            stack[-1].children.append(s)
        if mark == "{":
            stack.append(s or Statement("", None, line))
            columns.append(here if s else None)
        elif mark == "}" and len(stack) > 1:
            stack.pop()
            columns.pop()
    return top, len(stack) - 1, closed


def statement_rows(file: str, text: str) -> list[tuple]:
    """STATEMENT rows in the order of the file; trail: the keywords from the top to it."""
    rows: list[tuple] = []
    top = parse(text)
    module = next((s.arg for s in top if s.keyword in ("module", "submodule")), None)

    def walk(s: Statement, parent: int | None, ord_: int, trail: list[str]) -> None:
        me, trail = len(rows), [*trail, s.keyword]
        rows.append((file, module, me, parent, ord_, len(trail) - 1, s.prefix, s.keyword, s.arg, s.line, trail))
        for i, c in enumerate(s.children):
            walk(c, me, i, trail)

    for i, s in enumerate(top):
        walk(s, None, i, [])
    return rows


def type_descriptor(s: Statement, target: Callable[[str], str]) -> dict:
    """What a type statement says, with its members; names of derived types, bases and
    identities as module:name. Bits without a position follow the one before."""
    name = s.arg or ""
    out: dict = {"name": name if name in model.BUILTIN else target(name)}
    if not s.children:
        return {**out, "pattern": []}
    for key in ("range", "length", "path", "require-instance", "fraction-digits"):
        if s.first(key) is not None:
            out[key] = s.first(key)
    if s.first("base") is not None:
        out["base"] = target(s.first("base") or "")
    out["pattern"] = [c.arg or "" for c in s.all("pattern")]
    if s.all("enum"):
        out["enum"] = [c.arg for c in s.all("enum")]
    if s.all("bit"):
        at, bits = -1, {}
        for c in s.all("bit"):
            own = c.first("position")
            at = int(own) if own and own.isdigit() else at + 1
            bits[c.arg] = at
        out["bit"] = bits
    if s.all("type"):
        out["members"] = [type_descriptor(c, target) for c in s.all("type")]
    return out


_NODES = frozenset((*model.STRUCTURAL, "notification", "input", "output", "feature", "submodule", "annotation", "refine"))
_CONSTRAINT = frozenset(model.CONSTRAINT)
_DESCRIBED = frozenset(("type", "typedef", "identity"))
#: Descriptors of the built-in types as they are.
_PLAIN = {name: json.dumps({"name": name, "pattern": []}) for name in model.BUILTIN}


def node_rows(file: str, text: str) -> list[list]:
    """NODE rows, each with its properties (kind, field, pos, value). A node's path is its parent's and its argument (for a type
    the word "type", in a union the type's name); siblings that share one get [i]. What
    refines or augments a ``uses`` has the path of its target, below the user. ``uses``
    holds module:grouping, by the prefixes of the file; ``type_json`` the descriptor of a
    type, of a typedef's type, or the bases of an identity; ``node_id`` counts the nodes of
    a file in its order, and ``last_id`` is that of the last one below."""
    nodes: list[list] = []

    def target(name: str) -> str:
        """module:grouping that a name stands for in this file; ?name for an unknown prefix."""
        prefix, _, local = name.rpartition(":")
        if not prefix:
            return f"{module_of[None]}:{local}"
        return f"{module_of[prefix]}:{local}" if prefix in module_of else f"?{name}"

    def aim(s: Statement, parent: Statement | None) -> str | None:
        """The node that a deviation, or a part of it, is about: module/path without prefixes."""
        owner = s if s.keyword == "deviation" else parent
        if s.prefix or owner is None or owner.keyword != "deviation" or not owner.arg:
            return None
        steps = [x for x in owner.arg.split("/") if x]
        head = target(steps[0]).rpartition(":")[0].lstrip("?") if steps else ""
        return "/".join([head, *(x.rpartition(":")[2] for x in steps)])

    def described(s: Statement) -> str | None:
        if s.keyword == "type":
            plain = None if s.children else _PLAIN.get(s.arg or "")
            return plain or json.dumps(type_descriptor(s, target))
        if s.keyword == "typedef" and s.all("type"):
            return json.dumps(type_descriptor(s.all("type")[0], target))
        if s.keyword == "identity":
            return json.dumps({"bases": [target(c.arg or "") for c in s.all("base")]})
        return None

    def segment(s: Statement, parent: Statement | None) -> str:
        if s.keyword == "type" and not s.prefix:
            return (s.arg or "type") if parent is not None and parent.keyword == "type" and parent.arg == "union" else "type"
        return (s.arg or s.keyword).strip("/") if s.keyword in model.BY_PATH else (s.arg or s.keyword)

    def walk(s: Statement, parent: Statement | None, path: str, rel: str | None, grouping: str | None, index: int | None, module: str) -> None:
        keyword, arg, prefix, children = s.keyword, s.arg, s.prefix, s.children
        seg = segment(s, parent)
        if index is not None:
            seg = f"{seg}[{index}]"
        if keyword == "augment" and parent is not None and parent.keyword in ("module", "submodule"):
            here = f"{path.split('/')[0]}/{seg}"
            inside = f"{rel}/{seg}" if rel else seg if grouping else None
        elif keyword in ("refine", "augment") and not prefix and parent is not None and parent.keyword == "uses":
            steps = "/".join(x.rpartition(":")[2] for x in (arg or "").split("/") if x)
            here = f"{path.rpartition('/')[0]}/{steps}"
            inside = "/".join(x for x in (rel.rpartition("/")[0], steps) if x) if rel else None
        else:
            here = f"{path}/{seg}" if path else seg
            inside = f"{rel}/{seg}" if rel else seg if grouping else None
        me = len(nodes)
        type_name = arg if keyword == "type" else s.first("type") if children else None
        props: list[tuple] = [] if arg is None else [("attribute", "name", 0, arg)]
        told = described(s) if keyword in _DESCRIBED and not prefix else None
        aimed = aim(s, parent) if keyword == "deviation" or (parent is not None and parent.keyword == "deviation") else None
        row = [file, module, me, here, f"{prefix}:{keyword}" if prefix else keyword, arg, type_name, s.line, grouping, inside, target(arg or "") if keyword == "uses" else None, told, aimed, me, props]
        nodes.append(row)
        if not children:
            return
        count: dict[str, int] = {}
        below: dict[tuple, list[Statement]] = {}
        for c in children:
            if c.children if c.prefix else c.keyword in _NODES:
                below.setdefault((c.keyword, c.arg), []).append(c)
                continue
            name = f"{c.prefix}:{c.keyword}" if c.prefix else c.keyword
            pos = count.get(name, 0)
            count[name] = pos + 1
            props.append(("constraint" if c.keyword in _CONSTRAINT else "attribute", name, pos, "true" if c.arg is None else c.arg))
        if keyword == "grouping":
            inside, grouping = None, arg
        for same in below.values():
            if len(same) == 1:
                walk(same[0], s, here, inside, grouping, None, module)
                continue
            for i, c in enumerate(same):
                walk(c, s, here, inside, grouping, i, module)
        row[13] = len(nodes) - 1

    for s in parse(text):
        if s.keyword in ("module", "submodule"):
            owner = s.first("belongs-to") or s.arg or ""
            module_of: dict[str | None, str] = {None: owner}
            for c in (s, *s.all("belongs-to"), *s.all("import")):
                module_of[c.first("prefix") or c.arg or ""] = owner if c is s else c.arg or ""
            top = Statement(s.keyword, s.arg, s.line, None, s.children)
            walk(top, None, "", None, None, None, owner)
            if owner != s.arg:  # a submodule's nodes are its module's
                for row in nodes:
                    if row[3].startswith(s.arg or ""):
                        row[3] = owner + row[3][len(s.arg or "") :]
    return nodes


def read_files(spark: SparkSession, folder: str, pattern: str = "*.yang") -> DataFrame:
    """(file, text): each file whole."""
    return spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("file"), F.col("value").alias("text"))


_S, _I = pa.string(), pa.int32()
#: Rows and characters of files after which a batch is passed on.
_BATCH_ROWS, _BATCH_CHARS = 8192, 8 << 20


def _batches(batches: Iterator[pa.RecordBatch], rows_of: Callable[[str, str], list[tuple]], make: Callable[[list[tuple]], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of many small files in a batch; a file's rows stay in one."""
    held: list[tuple] = []
    chars = 0
    for b in batches:
        for f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held += rows_of(f, t or "")
            chars += len(t or "")
            if len(held) >= _BATCH_ROWS or chars >= _BATCH_CHARS:
                if held:
                    yield make(held)
                held, chars = [], 0
    if held:
        yield make(held)


def _chosen(every: str, columns: tuple[str, ...]) -> tuple[list[str], list[int], str]:
    """Names, places and schema of the chosen columns of a row type; of none, all."""
    parts = every.split(", ")
    at = [i for i, x in enumerate(parts) if not columns or x.split()[0] in columns]
    return [parts[i].split()[0] for i in at], at, ", ".join(parts[i] for i in at)


def statements(files: DataFrame, keywords: tuple[str, ...] = (), columns: tuple[str, ...] = ()) -> DataFrame:
    """STATEMENT rows of (file, text) rows; null texts have none. Where ``keywords`` or
    ``columns`` are named, only these leave the parser."""
    ship(files.sparkSession)
    names, at, schema = _chosen(model.STATEMENT, columns)
    kinds = [[_S, _S, _I, _I, _I, _I, _S, _S, _S, _I, pa.list_(_S)][i] for i in at]
    wanted = frozenset(keywords)

    def rows_of(file: str, text: str) -> list[tuple]:
        rows = statement_rows(file, text)
        return [r for r in rows if r[7] in wanted] if wanted else rows

    def make(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(cols[i], t) for i, t in zip(at, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(batches, rows_of, make)

    return files.select("file", "text").mapInArrow(run, schema)


def nodes(files: DataFrame, keywords: tuple[str, ...] = (), columns: tuple[str, ...] = ()) -> DataFrame:
    """NODE rows with ``props``, an array of (kind, field, pos, value). Where ``keywords`` or
    ``columns`` (without props) are named, only these leave the parser."""
    ship(files.sparkSession)
    fields = [("kind", _S), ("field", _S), ("pos", _I), ("value", _S)]
    names, at, schema = _chosen(model.NODE, columns)
    kinds = [[_S, _S, _I, _S, _S, _S, _S, _I, _S, _S, _S, _S, _S, _I][i] for i in at]
    if not columns:
        names, schema = [*names, "props"], f"{schema}, props array<struct<kind:string,field:string,pos:int,value:string>>"
    wanted = frozenset(keywords)

    def rows_of(file: str, text: str) -> list[list]:
        rows = node_rows(file, text)
        return [r for r in rows if r[4] in wanted] if wanted else rows

    def make(rows: list[list]) -> pa.RecordBatch:
        *cols, own = zip(*rows)
        arrays = [pa.array(cols[i], t) for i, t in zip(at, kinds)]
        if not columns:
            ends = np.cumsum([0, *map(len, own)], dtype=np.int32)
            parts = list(zip(*[p for ps in own for p in ps])) or [()] * len(fields)
            flat = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(parts, fields)], [n for n, _ in fields])
            arrays.append(pa.ListArray.from_arrays(pa.array(ends, _I), flat))
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(batches, rows_of, make)

    return files.select("file", "text").mapInArrow(run, schema)


#: Statements of a refinement that add to the target's own; others take their place.
_ADDED_BY_REFINE = ("must", "if-feature")


def expand_uses(rows: DataFrame) -> DataFrame:
    """``rows`` and, for each ``uses``, the nodes of its grouping below the user's parent,
    as its refinements and augments leave them. A grouping is known by its module and its
    name. Groupings that use others are expanded in rounds of joins until none is left; one
    that comes to use itself is not expanded inside itself.

    Refinements are rows with the path of their target, expanded like any other; what a
    user says counts after what the grouping it uses says."""
    inside = rows.where(F.col("rel_path").isNotNull()).select(F.concat_ws(":", "module", "grouping").alias("g"), F.col("rel_path").alias("g_rel"), *[F.col(c).alias(f"g_{c}") for c in ("file", "module", "node_id", "keyword", "name", "type_name", "line", "uses", "type_json", "last_id", "props")])
    at = F.regexp_replace("path", "/[^/]*$", "").alias("at")
    out = [rows.withColumn("__depth", F.lit(0))]
    front = rows.where(F.col("uses").isNotNull() & F.col("grouping").isNull()).select(at, F.col("uses").alias("want"), F.array("uses").alias("chain"))
    while True:
        made = stored(front.join(inside, F.col("want") == F.col("g")).select(
            F.col("g_file").alias("file"), F.col("g_module").alias("module"), F.col("g_node_id").alias("node_id"), F.concat_ws("/", "at", "g_rel").alias("path"), F.col("g_keyword").alias("keyword"), F.col("g_name").alias("name"),
            F.col("g_type_name").alias("type_name"), F.col("g_line").alias("line"), F.lit(None).cast("string").alias("grouping"), F.lit(None).cast("string").alias("rel_path"), F.col("g_uses").alias("uses"), F.col("g_type_json").alias("type_json"), F.lit(None).cast("string").alias("target"), F.col("g_last_id").alias("last_id"), F.col("g_props").alias("props"), F.size("chain").alias("__depth"), "chain",
        ))
        if not made.limit(1).count():
            return _refined(reduce(DataFrame.unionByName, out)).drop("__depth")
        out.append(made.drop("chain"))
        deeper = made.where(F.col("uses").isNotNull() & ~F.array_contains("chain", F.col("uses")))
        front = deeper.select(at, F.col("uses").alias("want"), F.concat("chain", F.array("uses")).alias("chain"))


def _refined(rows: DataFrame) -> DataFrame:
    """Expanded nodes with what refines them, the innermost refinement first. One join of
    paths; refinements inside a grouping's own text stay as rows. Where nothing refines, the
    rows themselves."""
    live = F.col("grouping").isNull()
    if not rows.where(live & (F.col("keyword") == "refine")).limit(1).count():
        return rows
    said = F.filter("props", lambda p: p["field"] != "name")
    overlay = rows.where(live & (F.col("keyword") == "refine")).groupBy(strip_prefixes(F.col("path")).alias("__path")).agg(F.array_sort(F.collect_list(F.struct((-F.col("__depth")).alias("d"), F.col("node_id").alias("i"), said.alias("props")))).alias("__over"))
    kept = rows.where(~(live & (F.col("keyword") == "refine")))

    def put(props: Column, over: Column) -> Column:
        fresh = over["props"]
        old = F.filter(props, lambda p: p["field"].isin(*_ADDED_BY_REFINE) | ~F.exists(fresh, lambda q: q["field"] == p["field"]))
        n = lambda q: F.size(F.filter(old, lambda p: p["field"] == q["field"]))
        return F.concat(old, F.transform(fresh, lambda q: F.struct(q["kind"].alias("kind"), q["field"].alias("field"), (q["pos"] + n(q)).cast("int").alias("pos"), q["value"].alias("value"))))

    hit = kept.join(overlay, live & ~F.col("keyword").isin("type", "uses", "augment") & (strip_prefixes(F.col("path")) == F.col("__path")), "left")
    props = F.when(F.col("__over").isNull(), F.col("props")).otherwise(F.aggregate("__over", F.col("props"), put))
    return hit.withColumn("props", props).select(*rows.columns)


def by_revision(rows: DataFrame) -> DataFrame:
    """Nodes of files of which some are revisions of one module. The newest revision has the
    module's name; others are known as module@revision, and of them only what can be used
    elsewhere stays (groupings, typedefs, identities). An import with a revision-date speaks
    of the newest revision up to that date, or else of the oldest; without one, of the
    newest. Submodules of a revision are those as of its date. Where no module has two
    revisions, the rows themselves.

    Choices are aggregates of equality joins on the module's name; a revision of null is
    before all others, and files of one module and revision count together."""
    files = rows.where("keyword in ('module', 'submodule')").select("file", "module", "keyword", "name")
    dates = rows.where("keyword = 'revision'").groupBy("file").agg(F.max("name").alias("revision"))
    files = files.join(dates, "file", "left").fillna("", ["revision"])
    newest = files.groupBy("keyword", "name").agg(F.max("revision").alias("newest"), F.count_distinct("revision").alias("n"))
    if not newest.where("n > 1").limit(1).count():
        return rows
    told = stored(files.join(newest, ["keyword", "name"]))
    alias = F.when(F.col("revision") == F.col("newest"), F.col("module")).otherwise(F.concat_ws("@", "module", "revision"))
    modules = told.where("keyword = 'module'").select("file", "module", "revision", alias.alias("alias"))
    as_of = lambda at, *of: F.coalesce(F.max(F.when(F.col("revision") <= at, F.struct("revision", *of))), F.min(F.struct("revision", *of)))
    subs = told.where("keyword = 'submodule'").select("file", "module", "name", "revision")
    users = modules.select("module", F.col("revision").alias("at"), "alias").distinct()
    met = subs.join(users, "module", "left").withColumn("alias", F.coalesce("alias", "module"))
    latest = F.when(F.col("alias") == F.col("module"), F.lit("\uffff")).otherwise(F.col("at"))
    picked = met.withColumn("at", latest).groupBy("module", "name", "alias", "at").agg(as_of(F.col("at"))["revision"].alias("revision"))
    homes = modules.select("file", "alias").unionByName(subs.join(picked, ["module", "name", "revision"]).select("file", "alias"))

    date = F.get(F.transform(F.filter("props", lambda p: p["field"] == "revision-date"), lambda p: p["value"]), F.lit(0))
    imports = rows.where("keyword = 'import'").select("file", F.col("name").alias("module"), date.alias("wanted")).where("wanted is not null").distinct()
    asked = imports.select("module", "wanted").distinct().join(modules, "module").groupBy("module", "wanted").agg(as_of(F.col("wanted"), "alias")["alias"].alias("to"))
    swaps = imports.join(asked, ["module", "wanted"]).where(F.col("to") != F.col("module")).groupBy("file").agg(F.array_sort(F.collect_set(F.struct(F.col("module").alias("m"), "to"))).alias("__swaps"))

    out = rows.join(homes, "file").join(swaps, "file", "left")
    older = F.col("alias") != F.col("module")
    out = out.where(~older | F.col("keyword").isin("grouping", "typedef", "identity") | F.col("rel_path").isNotNull())
    own = F.when(older, F.array(F.struct(F.col("module").alias("m"), F.col("alias").alias("to")))).otherwise(F.array().cast("array<struct<m:string,to:string>>"))
    out = out.withColumn("__swaps", F.concat(F.coalesce("__swaps", F.array().cast("array<struct<m:string,to:string>>")), own))

    def put(c: str, *lefts: str) -> Column:
        swap = lambda v, x, left: F.replace(v, F.concat(F.lit(left), x["m"], F.lit(":")), F.concat(F.lit(left), x["to"], F.lit(":")))
        return F.aggregate("__swaps", F.col(c), lambda v, x: reduce(lambda w, left: swap(w, x, left), lefts, v))

    uses = F.aggregate("__swaps", F.col("uses"), lambda v, x: F.when(F.substring_index(v, ":", 1) == x["m"], F.concat_ws(":", x["to"], F.substring_index(v, ":", -1))).otherwise(v))
    json_ = F.when(F.col("keyword") == "identity", put("type_json", '"')).otherwise(put("type_json", '"name": "', '"base": "'))
    path = F.when(older, F.concat("alias", F.expr("substring(path, length(module) + 1)"))).otherwise(F.col("path"))
    return stored(out.withColumn("uses", uses).withColumn("type_json", json_).withColumn("path", path).withColumn("module", F.col("alias")).select(*rows.columns))


def without_older(rows: DataFrame) -> DataFrame:
    """Nodes without the text of older revisions; what others took from there stays."""
    return rows.where(~F.col("path").rlike("^[^/]*@"))


def grouping_contexts(rows: DataFrame) -> DataFrame:
    """(grouping as module:name, at): every path below which a grouping is expanded,
    directly or by way of the groupings that use it."""
    every = expand_uses(rows).where(F.col("uses").isNotNull() & F.col("grouping").isNull())
    return every.select(F.col("uses").alias("grouping"), F.regexp_replace("path", "/[^/]*$", "").alias("at")).distinct()


def definitions(rows: DataFrame) -> DataFrame:
    """(name, json, refs): typedefs by module:name with their type's descriptor, and
    "identity module:name" with the array of all identities derived from it; refs are the
    definitions that each names."""
    from tessera.operators.graph import closure

    key = F.concat_ws(":", "module", "name")
    found = rows.where("keyword = 'typedef' and type_json is not null").groupBy(key.alias("name")).agg(F.max_by("type_json", F.struct("file", "node_id")).alias("json"))
    up = rows.where("keyword = 'identity' and type_json is not null").select(key.alias("child"), F.explode(F.from_json("type_json", "bases array<string>")["bases"]).alias("parent"))
    derived = closure(up, "child", "parent").groupBy("ancestor").agg(F.to_json(F.array_sort(F.collect_set("child"))).alias("json"))
    every = found.unionByName(derived.select(F.concat(F.lit("identity "), "ancestor").alias("name"), "json"))
    return stored(every.select("name", "json", references(F.col("json")).alias("refs")))


def references(type_json: Column) -> Column:
    """Names of the typedefs and of the identity sets that a descriptor speaks of."""
    names = F.regexp_extract_all(type_json, F.lit('"name": "([^"]+:[^"]+)"'), F.lit(1))
    bases = F.regexp_extract_all(type_json, F.lit('"base": "([^"]+)"'), F.lit(1))
    return F.array_distinct(F.concat(names, F.transform(bases, lambda b: F.concat(F.lit("identity "), b))))


def with_definitions(types: DataFrame, known: DataFrame, key: str = "type_json") -> DataFrame:
    """(key, defs): for each distinct descriptor that names any, the definitions that it
    comes to use, as JSON of name to descriptor. Each holds what one type reaches."""
    from tessera.operators.graph import closure

    refs = types.select(key).where(F.col(key).isNotNull()).distinct().select(key, F.explode(references(F.col(key))).alias("ref"))
    edges = known.select("name", F.explode("refs").alias("ref"))
    reach = closure(edges, "name", "ref").select(F.col("child").alias("ref"), F.col("ancestor").alias("far"))
    every = refs.unionByName(refs.join(reach, "ref").select(key, F.col("far").alias("ref"))).distinct()
    held = every.join(known.select(F.col("name").alias("ref"), "json"), "ref")
    return held.groupBy(key).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ref", "json"))))).alias("defs"))


def told(rows: DataFrame, defs: DataFrame, key: str = "type_json") -> DataFrame:
    """``rows`` with ``defs`` of ``with_definitions``, null where a descriptor names none.
    Only rows whose descriptor names any meet it: the few plain types that most rows have
    would each be one task's."""
    names = F.coalesce(F.size(references(F.col(key))) > 0, F.lit(False))
    plain = rows.where(~names).withColumn("defs", F.lit(None).cast("string"))
    return rows.where(names).join(defs, key, "left").select(*plain.columns).unionByName(plain)


def apply_deviations(rows: DataFrame) -> DataFrame:
    """Nodes as the deviations leave them. not-supported takes a node and what is below it
    away; add appends properties, replace gives those of the same name other values, and
    delete takes away properties of the same name and value. Targets are known by module
    and path; of several deviations of one node all properties count. Where nothing
    deviates, the rows themselves."""
    if not rows.where(F.col("keyword").isin("deviation", "deviate")).limit(1).count():
        return rows
    path = strip_prefixes(F.col("path"))
    marks = rows.where((F.col("keyword") == "deviate") & F.col("target").isNotNull())
    gone = marks.where("name = 'not-supported'").select(F.col("target").alias("gone")).distinct()
    up = rows.select(F.col("path").alias("p"), F.explode(F.concat(ancestors(path), F.array(path))).alias("a"))
    hit = up.join(gone, F.col("a") == F.col("gone"), "left_semi").select("p").distinct()
    own = rows.where(F.col("keyword").isin("deviation", "deviate"))
    kept = rows.where(~F.col("keyword").isin("deviation", "deviate")).join(hit, F.col("path") == F.col("p"), "left_anti")
    said = F.filter("props", lambda p: p["field"] != "name")
    changes = marks.where("name in ('add', 'replace', 'delete')").groupBy("target").agg(*[F.flatten(F.collect_list(F.when(F.col("name") == kind, said))).alias(f"__{kind}") for kind in ("add", "replace", "delete")])
    both = kept.join(changes.withColumnRenamed("target", "__target"), path == F.col("__target"), "left")
    same = lambda p, of: F.exists(F.col(of), lambda q: q["field"] == p["field"])
    left = F.filter("props", lambda p: ~same(p, "__replace") & ~F.exists("__delete", lambda q: (q["field"] == p["field"]) & q["value"].eqNullSafe(p["value"])))
    props = F.when(F.col("__target").isNull(), F.col("props")).otherwise(F.concat(left, "__replace", "__add"))
    return own.unionByName(both.withColumn("props", props).select(*rows.columns))


def owners(stmts: DataFrame) -> DataFrame:
    """(file, owner): the module that a file's definitions belong to; a submodule's are its
    module's."""
    to = F.max(F.when(F.col("keyword") == "belongs-to", F.col("arg")))
    return stmts.where("keyword in ('module', 'submodule', 'belongs-to')").groupBy("file").agg(F.coalesce(to, F.max("module")).alias("owner"))


def _with_module(rows: DataFrame, stmts: DataFrame, name: str) -> DataFrame:
    """``rows`` (with file) with <name>_module: the module that a name is looked for in, by
    its prefix, or the file's own where it has none; null where the prefix is unknown."""
    known = resolve_prefixes(rows, prefixes(stmts), name).join(owners(stmts).withColumnRenamed("file", "__f"), F.col("file") == F.col("__f"), "left")
    return known.withColumn(f"{name}_module", F.when(F.col(name).contains(":"), F.col(f"{name}_module")).otherwise(F.col("owner"))).drop("__f", "owner")


def typedefs(stmts: DataFrame) -> DataFrame:
    """(module, name, base, base_module): named types and the types they restrict; built-in
    types are of no module."""
    child = stmts.where("keyword = 'type'").select("file", F.col("parent_id").alias("stmt_id"), F.col("arg").alias("base"))
    rows = _with_module(stmts.where("keyword = 'typedef'").join(child, ["file", "stmt_id"]), stmts, "base")
    home = F.when(~F.col("base").isin(*model.BUILTIN), F.col("base_module"))
    return rows.select("module", F.col("arg").alias("name"), F.regexp_replace("base", "^[^:]*:", "").alias("base"), home.alias("base_module"))


def identities(stmts: DataFrame) -> DataFrame:
    """(module, name, base, base_module): identities and their bases (null for roots)."""
    base = stmts.where("keyword = 'base'").select("file", F.col("parent_id").alias("stmt_id"), F.col("arg").alias("base"))
    rows = _with_module(stmts.where("keyword = 'identity'").join(base, ["file", "stmt_id"], "left"), stmts, "base")
    return rows.select("module", F.col("arg").alias("name"), F.regexp_replace("base", "^[^:]*:", "").alias("base"), F.when(F.col("base").isNotNull(), F.col("base_module")).alias("base_module"))


def prefixes(stmts: DataFrame) -> DataFrame:
    """(file, prefix, module): own and imported prefixes."""
    own = stmts.where("keyword = 'prefix'").select("file", F.col("parent_id").alias("stmt_id"), F.col("arg").alias("p"))
    up = stmts.where("keyword in ('module', 'import', 'belongs-to')").select("file", "stmt_id", F.col("arg").alias("m"))
    return own.join(up, ["file", "stmt_id"]).select("file", F.col("p").alias("prefix"), F.col("m").alias("module"))


def prefixes_of(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``prefixes`` from parsed nodes; submodules name theirs in statements that are no nodes,
    so where there are any, the files are read again."""
    if rows.where("keyword = 'submodule'").limit(1).count():
        return prefixes(statements(files, ("prefix", "module", "import", "belongs-to"), ("file", "stmt_id", "parent_id", "keyword", "arg")))
    named = F.filter("props", lambda p: p["field"] == "prefix")
    return rows.where("keyword in ('module', 'import')").select("file", F.explode(F.transform(named, lambda p: p["value"])).alias("prefix"), F.col("name").alias("module"))


def includes(stmts: DataFrame) -> DataFrame:
    """(module, included): edges for the closure of a module's submodules."""
    return stmts.where("keyword = 'include'").select("module", F.col("arg").alias("included"))


def outline(files: DataFrame) -> DataFrame:
    """(file, kind, name, belongs_to) by patterns alone, without parsing: enough to find
    modules and submodules among many files."""
    body = F.regexp_replace("text", r"(?s)/\*.*?\*/|//[^\n]*", "")
    grab = lambda p, i: F.nullif(F.regexp_extract(body, p, i), F.lit(""))
    head = r"^\s*(module|submodule)\s+\"?([A-Za-z_][\w.-]*)"
    return files.select("file", grab(head, 1).alias("kind"), grab(head, 2).alias("name"), grab(r"belongs-to\s+\"?([A-Za-z_][\w.-]*)", 1).alias("belongs_to"))


def scan(files: DataFrame) -> DataFrame:
    """(file, keyword, arg) of what looks like a statement, by one pattern over each
    file without its comments: a rough scan for files that need not be whole."""
    body = F.regexp_replace("text", r"(?s)/\*.*?\*/|//[^\n]*", "")
    found = F.regexp_extract_all(body, F.lit(r"([A-Za-z][\w:-]*)\s+(\"[^\"]*\"|[^\s{};\"]+)\s*[{;]"), F.lit(0))
    rows = files.select("file", F.explode(found).alias("s"))
    return rows.select("file", F.regexp_extract("s", r"^([A-Za-z][\w:-]*)", 1).alias("keyword"), F.regexp_replace(F.regexp_extract("s", r"^[^\s]+\s+(\"[^\"]*\"|[^\s{};\"]+)", 1), '"', "").alias("arg"))


def resolve_prefixes(rows: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """``rows`` (with file) with ``<name>_module``: the module that the prefix of a name
    stands for in its file; null without prefix or where it is unknown."""
    p = known.select(F.col("file").alias("__f"), F.col("prefix").alias("__p"), F.col("module").alias(f"{name}_module"))
    own = F.nullif(F.regexp_extract(name, "^([^:/]+):", 1), F.lit(""))
    return rows.join(p, (F.col("file") == F.col("__f")) & (own == F.col("__p")), "left").drop("__f", "__p")


def module_closure(stmts: DataFrame) -> DataFrame:
    """(child, ancestor, depth): all files that a module includes, directly or not."""
    from tessera.operators.graph import closure

    return closure(includes(stmts), "module", "included")


#: What ``diagnostics`` says of a statement and its parent.
PLACE = ("line", "keyword", "arg", "parent_line", "parent_keyword", "parent_arg")


def diagnostics(stmts: DataFrame) -> DataFrame:
    """(file, line, code, message) of references that name nothing: types, groupings and
    bases that the module their prefix stands for does not define, and unknown prefixes;
    with keyword and arg of the statement, and line, keyword and arg of its parent
    (parent_...). A name that another module defines is no match."""
    up = stmts.select("file", F.col("stmt_id").alias("parent_id"), *[F.col(c).alias(f"parent_{c}") for c in ("line", "keyword", "arg")])
    place = ["file", *PLACE]
    kinds = {"type": "typedef", "uses": "grouping", "base": "identity"}
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    used = stmts.where(F.col("prefix").isNull() & F.col("keyword").isin(*kinds) & F.col("arg").isNotNull() & ~((F.col("keyword") == "type") & F.col("arg").isin(*model.BUILTIN)))
    used = _with_module(used.join(up, ["file", "parent_id"], "left").withColumn("kind", kind[F.col("keyword")]), stmts, "arg")
    defined = stmts.where(F.col("keyword").isin(*kinds.values())).join(owners(stmts), "file").select(F.col("owner").alias("__m"), F.col("keyword").alias("__k"), F.col("arg").alias("__n")).distinct()
    local = F.regexp_replace("arg", "^[^:]*:", "")
    bad = used.join(defined, (F.col("arg_module") == F.col("__m")) & (F.col("kind") == F.col("__k")) & (local == F.col("__n")), "left_anti")
    lost = bad.select(*place, F.concat("keyword", F.lit("-not-found")).alias("code"), F.concat("kind", F.lit(" "), "arg", F.lit(" is not defined")).alias("message"))
    marked = stmts.where(F.col("prefix").isNotNull()).join(up, ["file", "parent_id"], "left")
    unknown = marked.join(prefixes(stmts), ["file", "prefix"], "left_anti").select(*place, F.lit("prefix-not-found").alias("code"), F.concat(F.lit("prefix "), "prefix", F.lit(" is not declared")).alias("message"))
    return lost.unionByName(unknown)


#: Statements whose argument is an expression, a pattern or a value.
EXPRESSIONS = ("must", "when", "pattern", "path", "default")


def fingerprints(stmts: DataFrame) -> DataFrame:
    """(file, stmt_id, keyword, fingerprint) of expressions and patterns."""
    from tessera.functions.text import fingerprint

    return stmts.where(F.col("keyword").isin(*EXPRESSIONS)).select("file", "stmt_id", "keyword", fingerprint(F.col("arg")).alias("fingerprint"))


def statement_graph(stmts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges): node_id, keyword, arg; source, target, type."""
    key = lambda c: F.concat_ws("#", "file", F.col(c).cast("string"))
    vertices = stmts.select(key("stmt_id").alias("node_id"), "keyword", "arg")
    edges = stmts.where("parent_id is not null").select(key("parent_id").alias("source"), key("stmt_id").alias("target"), F.lit("parent-child").alias("type"))
    return vertices, edges


def uses_signature(rows: DataFrame) -> DataFrame:
    """(module, grouping, n, signature) of nodes: groupings with one signature hold the
    same. Groupings of one name in two modules stay apart."""
    inside = rows.where(F.col("rel_path").isNotNull())
    return inside.groupBy("module", "grouping").agg(F.count(F.lit(1)).alias("n"), F.sha1(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "keyword", "rel_path", F.coalesce("type_name", F.lit(""))))), "\n").cast("binary")).alias("signature"))


def allowed(stmts: DataFrame, keywords: list[str]) -> DataFrame:
    """The statements of the given keywords and those of extensions; what is below a
    statement that goes is judged on its own."""
    return stmts.where((F.coalesce(F.col("prefix"), F.lit("")) != "") | F.col("keyword").isin(keywords))
