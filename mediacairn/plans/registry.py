"""Named queries over a data folder, each with the SQL that checks it."""

from .fixtures import Tables, with_clause

QUERIES = {}
CHECKS = {}


def query(name, needs="", check=None):
    """Register fn(tables) under `name`. `needs` names the projections `check` reads."""
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        QUERIES[name].__doc__ = fn.__doc__
        if check is not None:
            CHECKS[name] = (with_clause(*needs.split()) if needs else "") + check.strip()
        return fn
    return add


def sql_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def sql_case(key, table, default="NULL") -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {default} END"
