"""Jobs: each module has run(spark, ...), which works in the session it is given, and a command line that creates and stops one."""

from . import resource_grid, text_profile

QUERIES = {"job1_resource_grid": resource_grid.query, "job2_text_profile": text_profile.query}
SQL = {"job1_resource_grid": resource_grid.SQL, "job2_text_profile": text_profile.SQL}
