"""Reports, SQL jobs and the registered queries."""
