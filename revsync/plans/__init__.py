"""Jobs: tables with committed versions, incremental loads, and the catalogue of queries."""
