"""Predicates to columns.

A filter becomes one boolean Column over live rows and a list of small side tables that are joined by
document first: graph predicates are decorrelated here, so that they may stand anywhere in the
boolean structure. Comparisons are gated by the type of the stored value; a mismatch is NULL.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.errors import filter_invalid
from notegraph.plans import cel
from notegraph.plans.visibility import Visibility, glob_to_regex

INTRINSICS = {"$path": "path", "$updated_at": "created_at", "$body": "body", "$content_hash": "content_hash"}
STRING_TESTS = ("contains", "startsWith", "endsWith", "matches")
_fresh = itertools.count()


def check_regex(pattern: str) -> str:
    """``pattern`` if it is in the linear-time dialect: no look-around, no back-references."""
    if re.search(r"(?<!\\)(?:\\\\)*(?:\(\?(?:[=!]|<[=!])|\\[1-9]|\\k<|\(\?>|[*+?}]\+)", pattern):
        raise filter_invalid("look-around, back-references and possessive quantifiers are not supported", pattern=pattern)
    try:
        re.compile(re.sub(r"\\[pP]\{[^}]*\}|\\z", ".", pattern))
    except re.error as e:
        raise filter_invalid(f"bad regular expression: {e}", pattern=pattern) from None
    return pattern


@dataclass
class Value:
    """A compiled operand. ``variant``: its type is known at run time only."""

    column: Column
    kind: str  # variant, string, bool, number, null


def gated(variant: Column, kind: str) -> Column:
    """The value if it is stored as ``kind``, else NULL."""
    of = F.schema_of_variant(variant)
    if kind == "string":
        return F.when(of == "STRING", F.try_variant_get(variant, "$", "string"))
    if kind == "bool":
        return F.when(of == "BOOLEAN", F.try_variant_get(variant, "$", "boolean"))
    numeric = of.isin("BIGINT", "DOUBLE", "FLOAT", "TINYINT", "SMALLINT", "INT") | of.startswith("DECIMAL")
    return F.when(numeric, F.try_variant_get(variant, "$", "double"))


def elements(variant: Column) -> Column:
    """The value as an array of variants: a list's elements, a scalar or object alone, and nothing for
    a missing key or a stored null."""
    of = F.schema_of_variant(variant)
    none = F.array().cast("array<variant>")
    return (
        F.when(variant.isNull() | (of == "VOID"), none)
        .when(of.startswith("ARRAY"), F.coalesce(F.try_variant_get(variant, "$", "array<variant>"), none))
        .otherwise(F.array(variant))
    )


@dataclass
class Tables:
    """What graph predicates read: live rows (document_id, repo_id, path, ...) and links (source_id,
    ord, field, target_norm, target_id)."""

    live: DataFrame
    links: DataFrame
    visibility: Visibility = field(default_factory=Visibility)


@dataclass
class Filter:
    """``column`` over live rows after ``join`` has attached the side tables."""

    column: Column
    sides: list[DataFrame]

    def apply(self, live: DataFrame) -> DataFrame:
        out = live
        for side in self.sides:
            out = out.join(side, "document_id", "left")
        return out.where(self.column).select(*live.columns)


def _swap(op: str) -> str:
    return {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op)


COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


class Compiler:
    """``row`` gives the column of a stored name; ``scope`` binds the variables of comprehensions."""

    def __init__(self, tables: Tables | None = None, prefix: str = "") -> None:
        self.tables, self.prefix = tables, prefix
        self.sides: list[DataFrame] = []
        self.scope: dict[str, Value | Compiler] = {}
        self.nested = False  # inside a comprehension over list()

    def col(self, name: str) -> Column:
        return F.col(f"{self.prefix}{name}")

    # Operands

    def path_of(self, node: cel.Node) -> tuple[str, list[str]]:
        fields: list[str] = []
        while isinstance(node, cel.Select):
            fields.append(node.field)
            node = node.operand
        if not isinstance(node, cel.Ident):
            raise filter_invalid("fields can be read of names only")
        return node.name, fields[::-1]

    def stored(self, node: cel.Node) -> Value:
        """The value behind a name or a path of fields."""
        name, fields = self.path_of(node)
        if name in self.scope:
            bound = self.scope[name]
            if isinstance(bound, Compiler):
                if not fields:
                    raise filter_invalid(f"{name} is a document: name one of its fields")
                inner: cel.Node = cel.Ident(fields[0])
                for f in fields[1:]:
                    inner = cel.Select(inner, f)
                return bound.stored(inner)
            if fields:
                raise filter_invalid(f"{name} is an element and has no fields here")
            return bound
        if name.startswith("$"):
            if name not in INTRINSICS:
                raise filter_invalid(f"unknown intrinsic {name}", expected=sorted(INTRINSICS))
            if fields:
                raise filter_invalid(f"{name} has no fields")
            return Value(self.col(INTRINSICS[name]), "string")
        where = "$" + "".join(f'["{f}"]' for f in (name, *fields))
        return Value(F.try_variant_get(self.col("frontmatter"), where, "variant"), "variant")

    def value(self, node: cel.Node) -> Value:
        if isinstance(node, cel.Const):
            if node.kind == "null":
                return Value(F.lit(None), "null")
            kind = {"string": "string", "bool": "bool"}.get(node.kind, "number")
            return Value(F.lit(float(node.value) if kind == "number" else node.value), kind)  # type: ignore[arg-type]
        if isinstance(node, cel.Ident | cel.Select):
            return self.stored(node)
        if node.name == "-_":
            inner = self.value(node.args[0])
            number = gated(inner.column, "number") if inner.kind == "variant" else inner.column
            return Value(-number, "number")
        if node.name == "size":
            return Value(self.size(node), "number")
        return Value(self.boolean(node), "bool")

    def typed(self, value: Value, kind: str) -> Column:
        if value.kind == "variant":
            return gated(value.column, kind)
        return value.column if value.kind == kind else F.lit(None)

    def compare(self, op: str, left: cel.Node, right: cel.Node) -> Column:
        a, b = self.value(left), self.value(right)
        if "null" in (a.kind, b.kind):
            return F.lit(None).cast("boolean")
        if a.kind == "variant" and b.kind == "variant":
            return F.coalesce(*[COMPARE[op](gated(a.column, k), gated(b.column, k)) for k in ("string", "number", "bool")])
        kind = b.kind if a.kind == "variant" else a.kind
        if "variant" not in (a.kind, b.kind) and a.kind != b.kind:
            return F.lit(None).cast("boolean")
        return COMPARE[op](self.typed(a, kind), self.typed(b, kind))

    # Calls

    def listed(self, node: cel.Node) -> Column | None:
        """The elements of ``list(x)``, or None if ``node`` is something else."""
        if isinstance(node, cel.Call) and node.name == "list" and node.target is None:
            if len(node.args) != 1 or not isinstance(node.args[0], cel.Ident | cel.Select):
                raise filter_invalid("list() takes one stored name")
            found = self.stored(node.args[0])
            return elements(found.column) if found.kind == "variant" else F.array(F.to_variant_object(F.array(found.column)))
        return None

    def size(self, node: cel.Call) -> Column:
        inner = node.target if node.target is not None else node.args[0] if len(node.args) == 1 else None
        if inner is None or (node.target is not None and node.args):
            raise filter_invalid("size() takes one argument")
        if isinstance(inner, cel.Call) and inner.name in ("$links", "$backlinks"):
            return self.link_count(inner)
        if node.target is not None:
            raise filter_invalid("size is a function: size(x)")
        if self.nested:
            raise filter_invalid("size() is not supported inside a comprehension")
        listed = self.listed(inner)
        if listed is not None:
            return F.size(listed).cast("double")
        return F.length(self.typed(self.value(inner), "string")).cast("double")

    def string_test(self, node: cel.Call) -> Column:
        args = (node.target, *node.args) if node.target is not None else node.args
        if len(args) != 2:
            raise filter_invalid(f"{node.name} takes two operands")
        if node.name == "matches":
            if self.nested:
                raise filter_invalid("matches() is not supported inside a comprehension")
            if not isinstance(args[1], cel.Const) or args[1].kind != "string":
                raise filter_invalid("matches() takes a constant pattern")
            return self.typed(self.value(args[0]), "string").rlike(check_regex(str(args[1].value)))
        text, part = (self.typed(self.value(a), "string") for a in args)
        return {"contains": F.contains, "startsWith": F.startswith, "endsWith": F.endswith}[node.name](text, part)

    def member(self, node: cel.Call) -> Column:
        listed = self.listed(node.args[1])
        if listed is None:
            raise filter_invalid("the right side of in must be list(...)")
        left = self.value(node.args[0])
        if left.kind == "null":
            return F.lit(False)

        def equal(e: Column) -> Column:
            if left.kind == "variant":
                both = [gated(e, k) == gated(left.column, k) for k in ("string", "number", "bool")]
                return F.coalesce(*both, F.lit(False))
            return F.coalesce(gated(e, left.kind) == left.column, F.lit(False))

        return F.exists(listed, equal)

    def comprehension(self, node: cel.Call) -> Column:
        assert node.target is not None
        if len(node.args) != 2 or not isinstance(node.args[0], cel.Ident):
            raise filter_invalid(f"{node.name}() takes a variable and a predicate")
        variable, body = node.args[0].name, node.args[1]
        if isinstance(node.target, cel.Call) and node.target.name in ("$links", "$backlinks"):
            return self.linked(node.target, node.name, variable, body)
        listed = self.listed(node.target)
        if listed is None:
            raise filter_invalid(f"{node.name}() needs list(...), $links() or $backlinks()")
        every = node.name == "all"

        def test(e: Column) -> Column:
            inner = Compiler(self.tables, self.prefix)
            inner.scope = self.scope | {variable: Value(e, "variant")}
            inner.nested = True
            found = F.coalesce(inner.boolean(body), F.lit(None).cast("boolean"))
            # A violation is a definite one: an element whose test is NULL does not count.
            return F.coalesce(~found if every else found, F.lit(False))

        return ~F.exists(listed, test) if every else F.exists(listed, test)

    # Graph predicates

    def need(self, what: str) -> Tables:
        if self.tables is None or self.nested:
            raise filter_invalid(f"{what} is not supported here")
        return self.tables

    def side(self, rows: DataFrame, value: Column, default: object) -> Column:
        """``rows`` (document_id, ...) reduced to one value a document, joined later; absent: ``default``."""
        name = f"_side{next(_fresh)}"
        self.sides.append(rows.groupBy("document_id").agg(value.alias(name)))
        return F.coalesce(F.col(name), F.lit(default))

    def others(self, way: str, tables: Tables) -> DataFrame:
        """(document_id, field, target_norm, and the columns of the other end as o_...) of every link:
        by source for $links, unresolved ones too, and by target for $backlinks."""
        live = tables.live.where(tables.visibility.visible())
        other = live.select(*[F.col(c).alias(f"o_{c}") for c in live.columns])
        links = tables.links
        if way == "$links":
            return links.select(F.col("source_id").alias("document_id"), "field", "target_norm", "target_id").join(
                other, F.col("target_id") == F.col("o_document_id"), "left"
            )
        return links.where("target_id IS NOT NULL").select(
            F.col("target_id").alias("document_id"), "field", "target_norm", "target_id", "source_id"
        ).join(other, F.col("source_id") == F.col("o_document_id"))

    def link_count(self, call: cel.Call) -> Column:
        """All link rows of a document, unresolved ones too, or all that point to it from visible ones."""
        tables = self.need(call.name)
        if call.name == "$links":
            rows = tables.links.select(F.col("source_id").alias("document_id"))
        else:
            rows = self.others(call.name, tables).select("document_id")
        return self.side(rows, F.count(F.lit(1)).cast("double"), 0.0)

    def glob_link(self, call: cel.Call) -> Column:
        """$in(glob, field?): some visible document matching the glob links here. $has(glob, field?):
        this document links to one, or to an unresolved path that matches."""
        tables = self.need(call.name)
        if not 1 <= len(call.args) <= 2 or not all(isinstance(a, cel.Const) and a.kind == "string" for a in call.args):
            raise filter_invalid(f"{call.name}() takes a glob and perhaps a field, as strings")
        texts = [str(a.value) for a in call.args]  # type: ignore[union-attr]
        rows = self.others("$backlinks" if call.name == "$in" else "$links", tables)
        if call.name == "$has":
            rows = rows.where(F.col("target_id").isNull() | F.col("o_document_id").isNotNull())
        rows = rows.where(F.coalesce("o_path", "target_norm").rlike(glob_to_regex(texts[0])))
        if len(texts) == 2:
            rows = rows.where(F.col("field") == texts[1])
        return self.side(rows, F.max(F.lit(True)), False)

    def linked(self, call: cel.Call, kind: str, variable: str, body: cel.Node) -> Column:
        """exists and all over the visible documents at the other end of links. Where the body mentions
        the outer document too, the two rows are joined before it is tested."""
        tables = self.need(call.name)
        other = Compiler(None, "o_")
        inner = Compiler(None)
        inner.scope = self.scope | {variable: other}
        test = inner.boolean(body)
        if kind == "all":
            test = ~test
        rows = self.others(call.name, tables).where("o_document_id IS NOT NULL")
        if cel.names(body, calls=False) - {variable}:
            outer = [c for c in tables.live.columns if c != "document_id"]
            rows = rows.join(tables.live.select("document_id", *outer), "document_id")
        found = self.side(rows.where(test), F.max(F.lit(True)), False)
        return ~found if kind == "all" else found

    # Booleans

    def boolean(self, node: cel.Node) -> Column:
        if isinstance(node, cel.Const):
            if node.kind == "bool":
                return F.lit(node.value)
            if node.kind == "null":
                return F.lit(None).cast("boolean")
            raise filter_invalid("a filter must be a condition")
        if isinstance(node, cel.Ident | cel.Select):
            found = self.stored(node)
            return self.typed(found, "bool").cast("boolean")
        name = node.name
        if node.target is None and name in ("&&", "||"):
            left, right = (self.boolean(a) for a in node.args)
            return left & right if name == "&&" else left | right
        if node.target is None and name == "!_":
            return ~self.boolean(node.args[0])
        if node.target is None and name in COMPARE:
            return self.compare(name, *node.args)
        if node.target is None and name == "in":
            return self.member(node)
        if name in STRING_TESTS:
            return self.string_test(node)
        if name in ("exists", "all") and node.target is not None:
            if self.nested:
                raise filter_invalid("comprehensions do not nest")
            return self.comprehension(node)
        if node.target is None and name in ("$in", "$has"):
            return self.glob_link(node)
        if name == "list":
            raise filter_invalid("list() needs in, exists, all or size around it")
        if name == "has":
            raise filter_invalid("has() is not supported; compare the field")
        raise filter_invalid(f"{name.strip('_')} is not supported as a condition")


def compile_filter(source: str | cel.Node, tables: Tables | None = None) -> Filter:
    node = cel.parse(source) if isinstance(source, str) else source
    compiler = Compiler(tables)
    return Filter(compiler.boolean(node), compiler.sides)
