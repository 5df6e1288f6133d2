"""Training-data operators: tokenising, search, archives, deduplication, packing, language, url filters."""


def queries():
    from docloom.llm.registry import QUERIES

    return dict(QUERIES)


def oracle_sql():
    from docloom.llm.registry import ORACLES

    return dict(ORACLES)
