"""Writers of tables, reports, charts, graphs and indexes."""
