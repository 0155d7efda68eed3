"""revsync: canonical CRM, calendar and payment tables and collected revenue, as Spark jobs."""
