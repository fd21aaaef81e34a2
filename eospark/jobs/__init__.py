"""Ready-made jobs: the registered queries and their SQL."""
