"""The same operators over live logs."""
