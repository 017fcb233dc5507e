"""Parcel agreement extraction and invoice audit as Spark DataFrame operators."""
