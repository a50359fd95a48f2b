"""What a physical plan does, node by node."""

from contextlib import contextmanager


@contextmanager
def planned_whole(spark):
    """Plans as they are made, without later changes; nothing is broadcast unasked."""
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def nodes(df):
    """(name, description, output columns) of each node."""

    def walk(node):
        out = node.output()
        yield node.nodeName(), node.simpleString(1000), [out.apply(i).name() for i in range(out.size())]
        for i in range(node.children().size()):
            yield from walk(node.children().apply(i))

    return list(walk(df._jdf.queryExecution().executedPlan()))


def exchanges(df):
    """(what it partitions by, output columns) of each shuffle."""
    return [(text, columns) for name, text, columns in nodes(df) if name == "Exchange"]
