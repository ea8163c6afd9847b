"""Column-level helpers. Everything here returns a ``Column`` built from
built-in Spark functions, so it stays inside whole-stage codegen."""
