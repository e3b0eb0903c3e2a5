"""Column functions of the policies: each maps columns of a row to columns of the same row, inside the JVM."""
