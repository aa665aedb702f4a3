"""Lumenark: a PySpark-first engine for note passages — scoped filters, ranked
retrieval, literal matching, aggregates, lint and incremental maintenance, all
expressed as lazy DataFrame plans."""
