"""quarry.operators.models"""
