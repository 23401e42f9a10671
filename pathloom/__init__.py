"""Return-path analytics on Spark: declarative operators first, Arrow kernels only where a step is sequential."""
