"""Schema-checked readers and the table / metric / head sinks."""

from hearth.sources.schemas import SCHEMAS, check_schema  # noqa: F401
from hearth.sources.tables import (  # noqa: F401
    from_pandas, read_excel, read_pair, read_table, spread, table_path,
)
from hearth.sources.sinks import (  # noqa: F401
    append_metrics, load_head, materialise, save_head, write_table,
)
