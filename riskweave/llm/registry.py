"""All queries of this package: the numbered operators, and the pipeline at the top of the repository."""

import corpus_pipeline

from . import queries as _queries


def queries():
    return _queries.QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    return _queries.SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
