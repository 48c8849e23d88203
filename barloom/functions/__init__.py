"""Row-wise functions over columns; a missing value (na) is null."""
