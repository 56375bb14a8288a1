"""runloom: Spark jobs for SQL reporting and for the records Spark applications leave behind."""
