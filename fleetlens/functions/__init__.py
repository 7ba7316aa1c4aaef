"""Column expressions. All are native: they stay in whole-stage code generation."""
