"""A-1..A-10: directory inventories with optional LIKE / = / flag filters.

Keyword names follow the tools (``<name>_filter``). Mandatory filters
(not deleted) and optional ones are applied before the projection, so
Catalyst pushes them to the scan (``prefix%`` becomes ``StringStartsWith``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlens.functions.accounts import ACCOUNT_FLAGS, FLAG_PARAMS
from grantlens.operators.filters import EQ, FLAG, LIKE, apply, build_filter, specs

FLAG_COLUMNS = [name for name, _ in ACCOUNT_FLAGS]
_FLAG_SPECS = specs(FLAG, {f"{p}_filter": c for p, c in FLAG_PARAMS.items()})


def _q(cols: list[str]) -> list:
    return [F.col(f"`{c}`") for c in cols]


# -- A-1 -----------------------------------------------------------------------
MEMBERSHIP_SPECS = specs(LIKE, {
    "group_dn_filter": "GroupDistinguishedName",
    "group_nt_account_filter": "GroupNTAccount",
    "group_sid_filter": "GroupObjectSid",
    "member_dn_filter": "MemberDistinguishedName",
    "member_nt_account_filter": "MemberNTAccount",
    "member_sid_filter": "MemberObjectSid",
    "member_object_class_filter": "MemberObjectClassName",
})
MEMBERSHIP_COLUMNS = ["GroupDistinguishedName", "GroupDomainCanonicalName", "GroupNTAccount", "GroupObjectSid",
                      "MemberDistinguishedName", "MemberDomainCanonicalName", "MemberNTAccount", "MemberObjectSid",
                      "MemberObjectClassName", "NestingLevel"]


def effective_group_members_view(closure: DataFrame, principals: DataFrame) -> DataFrame:
    """The closed-membership view: closure pairs with both sides' names."""
    g = principals.select(F.col("ObjectSid").alias("GroupSid"),
                          F.col("DistinguishedName").alias("GroupDistinguishedName"),
                          F.col("DomainCanonicalName").alias("GroupDomainCanonicalName"),
                          F.col("NTAccount").alias("GroupNTAccount"),
                          F.col("ObjectSid").alias("GroupObjectSid"))
    m = principals.select(F.col("ObjectSid").alias("MemberSid"),
                          F.col("DistinguishedName").alias("MemberDistinguishedName"),
                          F.col("DomainCanonicalName").alias("MemberDomainCanonicalName"),
                          F.col("NTAccount").alias("MemberNTAccount"),
                          F.col("ObjectSid").alias("MemberObjectSid"),
                          F.col("ObjectClassName").alias("MemberObjectClassName"))
    return closure.join(g, "GroupSid").join(m, "MemberSid") \
        .select(*MEMBERSHIP_COLUMNS[:-1], F.col("MinNestingLevel").alias("NestingLevel"))


def effective_membership(view: DataFrame, ignore_case: bool = False, **filters) -> DataFrame:
    """Get-ADEffectiveMembership ('' filters are ignored, as in the tool)."""
    cond = build_filter(view, MEMBERSHIP_SPECS, filters, skip_empty=True, ignore_case=ignore_case)
    return apply(view, cond).select(*MEMBERSHIP_COLUMNS).orderBy("GroupNTAccount", "MemberNTAccount")


# -- A-2 -----------------------------------------------------------------------
EXCEPTION_SPECS = specs(LIKE, {
    "name_filter": "Name",
    "description_filter": "Description",
    "principal_nt_account_filter": "PrincipalNTAccount",
    "object_class_filter": "PrincipalObjectClassName",
})


def ad_exceptions(exceptions: DataFrame, ignore_case: bool = False, **filters) -> DataFrame:
    cond = build_filter(exceptions, EXCEPTION_SPECS, filters, skip_empty=True, ignore_case=ignore_case)
    return apply(exceptions, cond).select(
        F.col("Name").alias("ExceptionName"), "Description", "PrincipalNTAccount",
        F.col("PrincipalObjectClassName").alias("ObjectClass")).orderBy("ExceptionName")


# -- A-3 -----------------------------------------------------------------------
PERMISSION_SPECS = specs(LIKE, {
    "access_entry_type_filter": "AccessEntryType",
    "access_entry_sid_filter": "AccessEntryObjectSID",
    "principal_name_filter": "AccessEntryPrincipalName",
    "principal_domain_filter": "AccessEntryDomain",
    "permission_filter": "AccessEntryPermission",
    "apply_to_filter": "AccessEntryApplyTo",
    "property_name_filter": "AccessEntryPropertyName",
    "dn_filter": "DistinguishedName",
    "object_sid_filter": "ObjectSid",
    "object_class_filter": "ObjectClass",
    "owner_sid_filter": "OwnerSid",
    "object_domain_filter": "Domain",
    "owner_domain_filter": "OwnerDomain",
}) + specs(FLAG, {"is_inherited_filter": "IsInherited"})
PERMISSION_COLUMNS = ["AccessEntryType", "AccessEntryObjectSID", "AccessEntryPrincipalName", "AccessEntryDomain",
                      "AccessEntryPermission", "AccessEntryApplyTo", "AccessEntryPropertyName", "IsInherited",
                      "DistinguishedName", "ObjectSid", "ObjectClass", "OwnerSid", "Domain", "OwnerDomain"]


def ad_permissions(perms: DataFrame, ignore_case: bool = False, **filters) -> DataFrame:
    cond = build_filter(perms, PERMISSION_SPECS, filters, ignore_case=ignore_case)
    base = perms.filter(F.col("isdeleted") == 0)
    return apply(base, cond).select(*PERMISSION_COLUMNS).orderBy("DistinguishedName", "AccessEntryPrincipalName")


# -- A-4..A-7 --------------------------------------------------------------------
def domain_controllers(dc_summary: DataFrame) -> DataFrame:
    return dc_summary


CERT_VULN_COLUMNS = ["Certificate Authority", "Name", "Published", "Template Vulnerabilities",
                     "Authority Vulnerabilities"]
CA_RIGHTS_COLUMNS = ["Certificate Authority", "CA String", "Domain", "NTAccount", "SID", "Access", "Ace Type",
                     "Direct"]
ASSESSMENT_COLUMNS = ["Category", "Check", "Finding", "Risk"]


def certificate_vulnerabilities(vulns: DataFrame) -> DataFrame:
    return vulns.select(*_q(CERT_VULN_COLUMNS))


def ca_rights(rights: DataFrame) -> DataFrame:
    return rights.select(*_q(CA_RIGHTS_COLUMNS))


def security_assessment(results: DataFrame) -> DataFrame:
    return results.select(*_q(ASSESSMENT_COLUMNS))


# -- A-8 -----------------------------------------------------------------------
USER_SPECS = specs(LIKE, {
    "domain_name_filter": "DomainName",
    "domain_canonical_filter": "DomainCanonicalName",
    "sam_account_name_filter": "SamAccountName",
    "nt_account_filter": "NTAccount",
    "display_name_filter": "DisplayName",
    "description_filter": "Description",
    "usn_filter": "USN",
    "object_sid_filter": "ObjectSid",
    "distinguished_name_filter": "DistinguishedName",
    "cn_filter": "Cn",
    "employee_id_filter": "EmployeeId",
    "when_created_filter": "WhenCreated",
    "when_changed_filter": "WhenChanged",
    "last_logon_filter": "LastLogonTimestamp",
    "account_expires_filter": "AccountExpires",
    "pwd_last_set_filter": "PwdLastSetDate",
    "mail_filter": "Mail",
    "title_filter": "Title",
    "company_filter": "Company",
    "department_filter": "Department",
    "telephone_filter": "TelephoneNumber",
    "legacy_exchange_dn_filter": "LegacyExchangeDN",
    "home_mdb_filter": "HomeMDB",
    "mailbox_store_filter": "MailboxStore",
    "storage_group_filter": "StorageGroup",
    "exchange_server_filter": "ExchangeServer",
}) + specs(EQ, {
    "domain_id_filter": "DomainId",
    "principal_id_filter": "PrincipalId",
    "dn_id_filter": "DnId",
    "manager_principal_id_filter": "ManagerPrincipalId",
}) + _FLAG_SPECS
USER_COLUMNS = ["DomainId", "DomainName", "DomainCanonicalName", "PrincipalId", "SamAccountName", "NTAccount",
                "DisplayName", "Description", "USN", "IsDeleted", "ObjectSid", "DnId", "DistinguishedName", "Cn",
                "EmployeeId", "WhenCreated", "WhenChanged", "Mail", "LastLogonTimestamp", "AccountExpires", "Title",
                "Company", "Department", "ManagerPrincipalId", "UserAccountControl",
                "msDSUserAccountControlComputed", "TelephoneNumber", "PwdLastSetDate", "LegacyExchangeDN",
                "HomeMDB", "MailboxStore", "StorageGroup", "ExchangeServer"] + FLAG_COLUMNS


def ad_users(users: DataFrame, ignore_case: bool = False, **filters) -> DataFrame:
    cond = build_filter(users, USER_SPECS, filters, ignore_case=ignore_case)
    return apply(users.filter(F.col("IsDeleted") == 0), cond).select(*USER_COLUMNS).orderBy("NTAccount")


# -- A-9 -----------------------------------------------------------------------
GROUP_SPECS = specs(LIKE, {
    "domain_name_filter": "DomainName",
    "domain_canonical_filter": "DomainCanonicalName",
    "sam_account_name_filter": "SamAccountName",
    "nt_account_filter": "NTAccount",
    "display_name_filter": "DisplayName",
    "description_filter": "Description",
    "usn_filter": "USN",
    "object_sid_filter": "ObjectSid",
    "distinguished_name_filter": "DistinguishedName",
    "cn_filter": "Cn",
    "when_created_filter": "WhenCreated",
    "when_changed_filter": "WhenChanged",
    "group_type_filter": "GroupType",
    "group_scope_filter": "GroupScope",
    "group_target_filter": "GroupTarget",
    "mail_filter": "Mail",
}) + specs(EQ, {
    "domain_id_filter": "DomainId",
    "principal_id_filter": "PrincipalId",
    "dn_id_filter": "DnId",
    "managed_by_principal_id_filter": "ManagedByPrincipalId",
    "direct_member_count_filter": "DirectMemberCount",
}) + specs(FLAG, {"is_deleted_filter": "IsDeleted"})
GROUP_COLUMNS = ["DomainId", "DomainName", "DomainCanonicalName", "PrincipalId", "SamAccountName", "NTAccount",
                 "DisplayName", "Description", "USN", "IsDeleted", "ObjectSid", "DnId", "DistinguishedName", "Cn",
                 "WhenCreated", "WhenChanged", "GroupType", "GroupScope", "GroupTarget", "Mail",
                 "ManagedByPrincipalId", "DirectMemberCount"]


def ad_groups(groups: DataFrame, ignore_case: bool = False, **filters) -> DataFrame:
    """Get-ADGroups: no mandatory filter (deleted groups included)."""
    cond = build_filter(groups, GROUP_SPECS, filters, ignore_case=ignore_case)
    return apply(groups, cond).select(*GROUP_COLUMNS).orderBy("NTAccount")


# -- A-10 ----------------------------------------------------------------------
COMPUTER_SPECS = specs(LIKE, {
    "domain_name_filter": "DomainName",
    "domain_canonical_filter": "DomainCanonicalName",
    "sam_account_name_filter": "SamAccountName",
    "nt_account_filter": "NTAccount",
    "display_name_filter": "DisplayName",
    "description_filter": "Description",
    "usn_filter": "USN",
    "object_sid_filter": "ObjectSid",
    "distinguished_name_filter": "DistinguishedName",
    "cn_filter": "Cn",
    "when_created_filter": "WhenCreated",
    "when_changed_filter": "WhenChanged",
    "last_logon_filter": "LastLogonTimestamp",
    "pwd_last_set_filter": "PwdLastSetDate",
    "dns_hostname_filter": "DnsHostName",
    "os_filter": "OperatingSystem",
    "os_version_filter": "OperatingSystemVersion",
    "os_sp_filter": "OperatingSystemServicePack",
    "location_filter": "Location",
}) + specs(EQ, {
    "domain_id_filter": "DomainId",
    "principal_id_filter": "PrincipalId",
    "managed_by_principal_id_filter": "ManagedByPrincipalId",
}) + _FLAG_SPECS
COMPUTER_COLUMNS = ["DomainId", "DomainName", "DomainCanonicalName", "PrincipalId", "SamAccountName", "NTAccount",
                    "DisplayName", "Description", "USN", "IsDeleted", "ObjectSid", "DistinguishedName", "Cn",
                    "WhenCreated", "WhenChanged", "DnsHostName", "OperatingSystem", "OperatingSystemVersion",
                    "OperatingSystemServicePack", "ManagedByPrincipalId", "Location", "LastLogonTimestamp",
                    "PwdLastSetDate", "UserAccountControl"] + FLAG_COLUMNS


def ad_computers(computers: DataFrame, ignore_case: bool = False, **filters) -> DataFrame:
    cond = build_filter(computers, COMPUTER_SPECS, filters, ignore_case=ignore_case)
    return apply(computers.filter(F.col("IsDeleted") == 0), cond).select(*COMPUTER_COLUMNS).orderBy("NTAccount")
