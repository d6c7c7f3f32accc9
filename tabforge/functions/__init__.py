"""Column-expression helpers (JVM-side, inside whole-stage codegen)."""
