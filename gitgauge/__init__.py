"""Repository intelligence as Spark jobs: rank, cut, cache, mine and check many repositories at once."""
