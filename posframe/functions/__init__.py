"""Column functions: arithmetic, strings, cells (arrays, maps, JSON), hashes, numeric libraries."""
