"""The query catalogue: each query as a plan, and as SQL that another engine can run."""
