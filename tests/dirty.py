"""Copies of the smallest tables: empty ones, and ones with rows of nulls, repeated rows and clashing extra columns."""

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

EXTRA = "id k v t p h r n x s c a b u word name part bands score entity ref_id grp record place end block slot quota size month_first utc_value kind src dst day firm tokens items event_id firm_id text source loaded_at deal headline extraction precision status spelling currency scale member group_id file_id doc_id title".split()


def copy(base: str, to: Path, empty: bool) -> str:
    for f in Path(base).glob("*.parquet"):
        t = pq.read_table(f)
        if empty:
            t = t.slice(0, 0)
        else:
            t = pa.concat_tables([t, pa.table({c.name: pa.nulls(2, c.type) for c in t.schema}, schema=t.schema), t.slice(0, 50)])
            for x in EXTRA:
                if x not in t.column_names:
                    t = t.append_column(x, pa.array(["clash"] * len(t)))
        pq.write_table(t, to / f.name)
    return str(to)


def rows(df) -> list[tuple]:
    return sorted(map(repr, map(tuple, df.collect())))
