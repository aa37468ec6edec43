"""weftline: column-lineage analytics and large-table data processing on Spark."""
