from tradewind.sources.csv_files import read_csv
from tradewind.sources.lakehouse import Lakehouse
from tradewind.sources.projection import as_variant, project, project_variant
from tradewind.sources.sql import query

__all__ = ["Lakehouse", "as_variant", "project", "project_variant", "query", "read_csv"]
