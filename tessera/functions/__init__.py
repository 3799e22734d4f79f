"""Column functions: Column(s) and parameters in, Column out; all JVM-side."""
