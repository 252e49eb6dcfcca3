"""File-inventory, synchronisation and transfer analytics as Spark DataFrame operators."""
