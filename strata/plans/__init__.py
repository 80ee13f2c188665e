"""End-to-end layer flows (e-commerce transactions, mainframe customers)
and the registered queries over the driver tables."""
