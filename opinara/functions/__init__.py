"""Column functions (JVM side) and small numerical routines (numpy, for K x K problems)."""
