"""Models: a task table in, one row for each run or prediction out."""
