"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from barline.plans import audits, evidence, records, relational, sequential, series, studies

QUERIES = {**series.QUERIES, **relational.QUERIES, **sequential.QUERIES, **evidence.QUERIES, **studies.QUERIES, **records.QUERIES, **audits.QUERIES}
ORACLE_SQL = {**series.ORACLE_SQL, **relational.ORACLE_SQL, **sequential.ORACLE_SQL, **evidence.ORACLE_SQL, **studies.ORACLE_SQL, **records.ORACLE_SQL, **audits.ORACLE_SQL}
