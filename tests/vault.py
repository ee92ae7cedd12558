"""A small collection built through the write operators."""

from notegraph.operators import links as link_ops
from notegraph.operators import writes
from notegraph.operators.store import VERSION_SCHEMA, Store, live

AT = "2026-01-01T00:00:{:02d}.000Z"

FILES = {
    "moc/index.md": ("title: Index\n", "See [mid](/notes/mid.md), [[leaf]] and [missing](gone.md)."),
    "notes/mid.md": ("title: Mid\ntags: [a, b]\n", "The quick foxes jump. Back to [up](../moc/index.md#top)."),
    "leaf.md": ("title: Leaf\nrelated: /notes/mid.md\n", "A fox jumps quickly over `[no](x.md)`."),
    "notes/.hidden.md": ("title: Hidden\n", "[mid](mid.md)"),
    "lone.md": ("", "Nothing here.\n\n## Head\n\ntext"),
}


def nothing(spark):
    return spark.createDataFrame([], VERSION_SCHEMA)


def vault(spark):
    versions = nothing(spark)
    for i, (path, (raw, body)) in enumerate(FILES.items()):
        versions, _ = writes.apply(versions, 1, [writes.Op("create", path, body, raw=raw)], AT.format(i))
    versions = spark.createDataFrame(versions.collect(), VERSION_SCHEMA)
    table = link_ops.backfill(live(versions))
    return Store(versions, links=spark.createDataFrame(table.collect(), table.schema))


def ids(versions):
    return {r.path: r.id for r in live(versions).select("path", "id").collect()}
