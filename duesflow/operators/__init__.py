"""General DataFrame operators the jobs are made of."""
